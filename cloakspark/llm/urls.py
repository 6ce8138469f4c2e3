"""URL filter by association rules.

Labelled URLs become sets of tokens. Spark's FP-growth mines frequent token combinations together with the label;
rules "tokens => block" are pruned by support and confidence, and dropped where a rule with fewer of the same
tokens is as confident. Each rule is posted under its rarest token; a URL looks up its tokens in that inverted
index and is blocked if all tokens of a found rule are its own. Fixed rules by host and path come first. All of it
is DataFrame functions.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm._common import ascii_lower, table

#: A combination must be in this share of the labelled URLs; this also bounds the rules: at most 2^t / SUPPORT for URLs of t frequent tokens.
SUPPORT = 0.004
CONFIDENCE = 0.6
#: Labelled URLs in which a combination must stand at least.
LEAST_URLS = 10
#: Fixed rules: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
_INDEX = "map<string,array<struct<items:array<string>,confidence:double>>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to the next /, ? or #, A-Z lower-cased. Path: from there to ? or #. Both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as host and path in one string, and its verdict; nulls for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its scheme, labels of the host, path segments, query pairs and fragment. Digit runs count as 0."""
    host, path = host_and_path(url)
    tail = lambda p: F.regexp_replace(F.coalesce(F.regexp_extract(url, p, 1), F.lit("")), r"\d+", "0")
    parts = [
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.array(F.concat(F.lit("host:"), host)),
        F.transform(F.split(F.regexp_replace(path, r"\d+", "0"), r"[/.]"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split(tail(r"\?([^#]*)"), "&"), lambda x: F.concat(F.lit("q:"), x)),
        F.array(F.concat(F.lit("f:"), tail(r"#(.*)$")), F.concat(F.lit("s:"), ascii_lower(F.coalesce(F.regexp_extract(url, r"^([^:/?#]*)://", 1), F.lit(""))))),
    ]
    return F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: ~x.rlike("^[a-z]+:$")))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """items, rarest, confidence, support of each rule kept. labelled: url, blocked (boolean); rows with a null in either are left out."""
    known = labelled.where("url is not null and blocked is not null")
    baskets = known.select(F.concat(tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit("label=block"))).otherwise(F.array().cast("array<string>"))).alias("items"))
    support = min(1.0, max(support, LEAST_URLS / max(1, baskets.count())))
    partitions = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=partitions).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit("label=block"))).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = rules.select("items", F.explode("items").alias("item")).join(single, "item").groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("rarest"))
    rules = rules.join(rarest, "items")
    # a rule goes if another one with some of its tokens is as confident: found under one of its tokens
    short = rules.select(F.col("items").alias("fewer"), F.col("rarest").alias("token"), F.col("confidence").alias("as_confident"))
    under = rules.select("items", "confidence", F.explode("items").alias("token")).join(short, "token")
    useless = under.where((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0) & (F.col("as_confident") >= F.col("confidence"))).select("items").distinct()
    return rules.join(useless, "items", "left_anti")


def index_of(rules: DataFrame) -> Column:
    """The inverted index as a constant: rarest token to the rules posted under it. Its size is bounded by SUPPORT."""
    posted = rules.groupBy("rarest").agg(F.array_sort(F.collect_list(F.struct("items", "confidence"))).alias("rules"))
    whole = posted.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("rarest", "rules")))).alias("index"))
    return F.from_json(F.lit(whole.first()["index"] or "{}"), _INDEX)


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row.

    `confidence` is that of the best mined rule that holds, null for none. A null url has an empty host and path and
    is allowed. Null ids and repeated rows pass through; columns other than page_id and url aren't read.
    """
    pages = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    index = index_of(rules)
    posted = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(index, t), F.array().cast("array<struct<items:array<string>,confidence:double>>"))))
    holding = lambda own: F.filter(posted, lambda r: F.size(F.array_except(r["items"], own)) == 0)
    best = F.array_max(F.transform(holding(F.col("tokens")), lambda r: r["confidence"]))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), best.alias("confidence")).select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence"
    )


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, blocked: pages whose path names a labelled document by its number; blocked if that is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("blocked"))
    _, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("url").withColumn("doc_id", F.regexp_extract(path, r"^/[^/]*/(\d+)", 1).try_cast("long"))
    return pages.join(labels, "doc_id").select("url", "blocked")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(table(spark, sf_dir, "pages"), mined(labelled_urls(spark, sf_dir)))


QUERIES = {"op5_urls": op5_urls}
ORACLES: dict[str, str] = {}
