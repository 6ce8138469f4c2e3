"""Benchmark decontamination by template canonicalisation.

A text becomes its words, in which numbers, units after numbers, and names (capitalised words inside a sentence)
are replaced by typed placeholders, so a question with other numbers or names has the same template. Windows of
WINDOW template words are hashed; documents and benchmark items meet by a hash join on windows. A document holds an
item if at least SIMILARITY of the item's windows stand in it, one that the item holds several times as often there, and the slots agree: the values behind the
placeholders must map one to one, by majority, for at least CONSISTENCY of the slot pairs. All of it is DataFrame
functions.

Before all windows of a document are built, those that can't hold any item are told by a few words and the windows
around them: see `anchors`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakspark.llm._common import checkpointed, table

WINDOW = 5
SIMILARITY = 0.8
CONSISTENCY = 0.8
#: The windows of the benchmark are broadcast up to this many rows (about 100 bytes each), else shuffled.
BROADCAST_WINDOWS = 200_000
#: Anchor words up to this many are a constant of the scan; more are joined with the documents' words.
CONSTANT_ANCHORS = 5_000
#: Ids of candidate documents up to this many (8 bytes each) are broadcast, else shuffled.
BROADCAST_IDS = 1_000_000
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s min h hour hours minute minutes second seconds day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents degree degrees mph kmh kg w kw v".split()
_WORD = r"\d+(?:[.,]\d+)*|[\p{L}\p{N}]+|[.!?\n]+"
_NAME = r"^\p{Lu}\p{Ll}+$"
#: A word with the sentence end before it, if there is one: as many as there are template words.
_MARKED = r"(?:[.!?\n][^\p{L}\p{N}]*)?(?:\d+(?:[.,]\d+)*|[\p{L}\p{N}]+)"


def _canonical(words: Column) -> Column:
    """array<struct<c, o>>: the template word and the original word of each word; sentence ends go."""
    # the first character tells a number (a digit) and a sentence end from a word, as _WORD is matched in that order
    number = lambda x: (x >= "0") & (x < ":")
    mark = lambda x: (x < "0") | x.startswith("?")

    def one(x: Column, i: Column) -> Column:
        prev = F.when(i > 0, F.get(words, i - 1))
        low = F.lower(x)
        kind = (
            F.when(mark(x), F.lit("."))
            .when(number(x), F.lit("<number>"))
            .when(prev.isNotNull() & number(prev) & low.isin(UNITS), F.lit("<unit>"))
            .when((low != x) & prev.isNotNull() & ~mark(prev) & x.rlike(_NAME), F.lit("<name>"))
            .otherwise(low)
        )
        return F.struct(kind.alias("c"), x.alias("o"))

    return F.filter(F.transform(words, one), lambda p: p["c"] != ".")


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD), 0)


def read(df: DataFrame, key: str) -> DataFrame:
    """key, t, c, d, o, n: template words in both readings, original words and their number. df: key, text."""
    words = df.select(key, F.xxhash64("text").alias("t"), _words("text").alias("words")).select(key, "t", _canonical(F.col("words")).alias("pairs"))
    words = words.select(key, "t", F.transform("pairs", lambda p: p["c"]).alias("c"), F.transform("pairs", lambda p: p["o"]).alias("o"), F.size("pairs").alias("n"))

    def capital(x: Column, i: Column) -> Column:
        own = F.get(F.col("o"), i)
        return F.when((x != own) & ~x.startswith("<") & own.rlike(_NAME), F.lit("<name>")).otherwise(x)

    return words.select(key, "t", "c", F.transform("c", capital).alias("d"), "o", "n")


def _hash(words: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(size)])


def near_hashes(marked: Column, place: Column, sizes: tuple[int, ...]) -> Column:
    """Hashes, in both readings, of the windows around a place of a text, read from those few words. marked: the words by _MARKED."""
    bare = lambda x: F.regexp_extract(x, r"(?s)[\p{L}\p{N}].*$", 0)
    number = lambda x: (x >= "0") & (x < ":")

    def template(i: Column) -> Column:
        own, before = F.get(marked, i), F.when(i > 0, F.get(marked, i - 1))
        x = bare(own)
        low, inside = F.lower(x), (own == x) & before.isNotNull()
        name = (low != x) & x.rlike(_NAME)
        first = F.when(number(x), F.lit("<number>")).when(inside & number(bare(before)) & low.isin(UNITS), F.lit("<unit>")).when(name & inside, F.lit("<name>")).otherwise(low)
        return F.struct(first.alias("c"), F.when(~first.startswith("<") & name, F.lit("<name>")).otherwise(first).alias("d"))

    # a one-element array binds the words of the place, so that they are worked out once
    bound = F.array(F.transform(F.sequence(F.greatest(place - WINDOW + 1, F.lit(0)), F.least(place + WINDOW - 1, F.size(marked) - 1)), template))

    def hashes(words: Column) -> Column:
        c, d = F.transform(words, lambda x: x["c"]), F.transform(words, lambda x: x["d"])

        def of(w: Column, size: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: _hash(w, i, size))

        return F.concat(*[of(w, size) for size in sizes for w in (c, d)])

    return F.flatten(F.transform(bound, hashes))


def anchors(benchmark: DataFrame) -> DataFrame | None:
    """item_id, w, word: windows of which a document must share one to hold the item, each with a plain word of it; None if an item has no such words.

    An item is held if SIMILARITY of its windows are shared, so of any more windows than may be missing one is shared,
    with all its words; a window that stands several times counts as often. Of each item those windows are taken whose longest plain word (in both readings) is longest, as
    long words are in few documents. benchmark: item_id, text.
    """
    words = read(benchmark, "item_id")
    plain = F.zip_with("c", "d", lambda c, d: F.when((c == d) & ~c.startswith("<"), F.struct(F.length(c).alias("size"), c.alias("word"))))
    words = words.where("n > 0").select("item_id", "c", plain.alias("plain"), "n")
    every = F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))
    best = F.transform(every, lambda i: F.struct(_hash(F.col("c"), i, WINDOW).alias("w"), F.array_max(F.filter(F.slice("plain", i + 1, WINDOW), lambda x: x.isNotNull())).alias("best")))
    each = words.distinct().select("item_id", F.explode(best).alias("x")).select("item_id", "x.w", "x.best").groupBy("item_id", "w").agg(F.max("best").alias("best"), F.count("*").alias("m"))
    n = F.sum("m").over(Window.partitionBy("item_id"))
    ordered = Window.partitionBy("item_id").orderBy(F.desc_nulls_last("best"), "w").rowsBetween(Window.unboundedPreceding, -1)
    chosen = each.select("item_id", "w", "best", n.alias("n"), F.coalesce(F.sum("m").over(ordered), F.lit(0)).alias("before")).where(F.col("before") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9))
    chosen = checkpointed(chosen.select("item_id", "w", "best.word"))
    return None if chosen.where("word is null").limit(1).count() else chosen


def candidates(docs: DataFrame, each: DataFrame, chosen: DataFrame | None, short: tuple[int, ...]) -> DataFrame:
    """The rows of documents that share a chosen window in any row of their id. docs: doc_id, text; each: the windows of the items.

    Words are looked for first, and windows are built around the words found only.
    """
    if chosen is None:
        return docs
    words, hashes = chosen.select("word").distinct(), each.join(chosen, ["item_id", "w"]).select("h").distinct()
    own = F.transform(_words("text"), F.lower)
    if words.limit(CONSTANT_ANCHORS + 1).count() <= CONSTANT_ANCHORS:
        known = F.array(*[F.lit(r["word"]) for r in words.orderBy("word").collect()]) if not words.isEmpty() else F.array().cast("array<string>")
        having = docs.where(F.arrays_overlap(own, known)).select("doc_id", "text", F.array_intersect(own, known).alias("hits"))
    else:
        found = docs.select("doc_id", F.explode(F.array_distinct(own)).alias("word")).join(words, "word", "left_semi").groupBy("doc_id").agg(F.collect_list("word").alias("hits"))
        having = docs.join(found, "doc_id")
    having = having.select("doc_id", "hits", F.regexp_extract_all("text", F.lit(_MARKED), 0).alias("marked"))
    hit = lambda x: F.array_contains("hits", F.lower(x)) | ((x < "0") | x.startswith("?")) & F.array_contains("hits", F.lower(F.regexp_extract(x, r"(?s)[\p{L}\p{N}].*$", 0)))
    places = F.filter(F.transform("marked", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())
    having = having.select("doc_id", "marked", places.alias("places"))
    # an outer explode, so that no predicate goes below it (see `windows`)
    around = F.transform("places", lambda p: near_hashes(F.col("marked"), p, (WINDOW, *short)))
    shared = having.select("doc_id", F.explode_outer(F.array_distinct(F.flatten(around))).alias("h"))
    few = hashes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    ids = checkpointed(shared.join(F.broadcast(hashes) if few else hashes, "h", "left_semi").select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def windows(df: DataFrame, key: str, short: tuple[int, ...] = ()) -> DataFrame:
    """key, t, i, m, w, h, b, slots: every window of template words, from word i on, of m words.

    t tells the texts of a key apart. slots are the original words where the window has placeholders, else null. A
    window with a capitalised word that may be a name at the start of a sentence has a second row (b) that reads all
    such words as names; h is the hash of the row's reading and w that of the first. Texts of fewer words are one
    window; texts without words have none. `short` has lengths below WINDOW at which longer texts are windowed too.
    df: key, text.
    """
    words = read(df, key)
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))
    words = words.select(key, "t", "c", "d", "o", "n", F.filter(every, lambda i: F.get(F.col("c"), i) != F.get(F.col("d"), i)).alias("starts"))

    def window(i: Column, size: int, second: bool) -> Column:
        parts = [F.get(F.col("d" if second else "c"), i + k) for k in range(size)]
        slotted = F.lit(False)
        for p in parts:
            slotted = slotted | F.coalesce(p.startswith("<"), F.lit(False))
        slots = F.when(slotted, F.transform(F.sequence(i, i + size - 1), lambda k: F.when(F.get(F.col("d" if second else "c"), k).startswith("<"), F.get(F.col("o"), k))))
        w = F.xxhash64(*[F.get(F.col("c"), i + k) for k in range(size)])
        return F.struct(i.alias("i"), F.least(F.col("n"), F.lit(size)).alias("m"), w.alias("w"), (F.xxhash64(*parts) if second else F.lit(None).cast("long")).alias("h"), F.lit(second).alias("b"), slots.alias("slots"))

    def both(size: int) -> list[Column]:
        last = F.greatest(F.col("n") - size, F.lit(0))
        whole = F.col("n") > (0 if size == WINDOW else size)
        near = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(F.greatest(p - size + 1, F.lit(0)), F.least(p, last)))))
        empty = F.array().cast("array<int>")
        return [F.transform(F.when(whole, F.sequence(F.lit(0), last)).otherwise(empty), lambda i: window(i, size, False)), F.transform(F.when(whole, near).otherwise(empty), lambda i: window(i, size, True))]

    # no filter on these columns, and an outer explode: a predicate would be pushed below the projections and inlined
    # into the lambdas, which then work out the words anew for each word
    found = words.select(key, "t", F.concat(*[x for size in (WINDOW, *short) for x in both(size)]).alias("w"))
    return found.select(key, "t", F.explode_outer("w").alias("w")).select(key, "t", "w.i", "w.m", "w.w", F.coalesce("w.h", "w.w").alias("h"), "w.b", "w.slots").where("h is not null")


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, consistency: the share of slot pairs that map one to one by majority. pairs: keys, theirs, slots."""
    values = pairs.where("slots is not null and theirs is not null").select(*keys, F.explode(F.arrays_zip(F.col("theirs").alias("a"), F.col("slots").alias("b"))).alias("p")).select(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("a is not null and b is not null")
    n = values.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    to = n.groupBy(*keys, "a").agg(F.max_by("b", F.struct("n", "b")).alias("best_b"))
    back = n.groupBy(*keys, "b").agg(F.max_by("a", F.struct("n", "a")).alias("best_a"))
    return n.join(to, [*keys, "a"]).join(back, [*keys, "b"]).groupBy(*keys).agg((F.sum(F.when((F.col("best_b") == F.col("b")) & (F.col("best_a") == F.col("a")), F.col("n")).otherwise(0)) / F.sum("n")).alias("consistency"))


def judged(shared: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_shared, n_windows, share, consistency of what is similar and consistent enough. shared: keys, n_shared, n_windows."""
    shared = shared.where(F.col("n_shared") >= SIMILARITY * F.col("n_windows"))
    out = shared.join(agreement(pairs, keys), keys, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    return out.where(F.col("consistency") >= CONSISTENCY).select(*keys, "n_shared", "n_windows", (F.col("n_shared") / F.col("n_windows")).alias("share"), "consistency")


def occurrences(met: DataFrame) -> DataFrame:
    """keys, place, w, theirs, slots: for each place of a text where an item may begin, the nearest match of each of the item's windows.

    A match votes for the places around its own, as words may be put in or left out: as many as windows may be missing.
    """
    keys = ["doc_id", "item_id"]
    at, reach = F.col("i") - F.col("their_i"), F.floor((1 - SIMILARITY) * F.col("n_windows")).cast("int")
    near = met.withColumn("place", F.explode(F.sequence(at - reach, at + reach)))
    near = near.groupBy(*keys, "t", "place", "their_i").agg(F.min_by(F.struct("w", "theirs", "slots", "n_windows", "i"), F.struct(F.abs(at - F.col("place")), F.col("b").cast("int"), F.col("i"))).alias("m"))
    return near.select(*keys, "t", "place", "their_i", "m.*")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_windows, share, consistency: a row per document and benchmark item that it holds.

    The windows of a whole document are judged together first, read as in `_canonical`. A document that falls short
    with that holds an item if one occurrence of it does: the item's windows at one place, in either reading (see
    `windows`), or all windows in either reading; the figures are then those of the most consistent one.

    docs: doc_id, text; benchmark: item_id, text; other columns aren't read. Null or empty texts hold nothing and are
    held by nothing; rows with equal ids count as one document; rows with a null id can't be named and are left out.
    An item without placeholders has consistency 1.
    """
    keys = ["doc_id", "item_id"]
    benchmark = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null")
    each = checkpointed(windows(benchmark, "item_id"))
    short = tuple(sorted(r["m"] for r in each.where(F.col("m") < WINDOW).select("m").distinct().collect()))
    # one row per item and window: the windows' own places and slots are kept in an array, as a window may stand twice
    items = each.groupBy("item_id", "h").agg(F.collect_set(F.struct(F.col("i").alias("their_i"), F.col("t").alias("their_t"), "w", "b", F.col("slots").alias("theirs"))).alias("item_windows"))
    sizes = each.where("not b").groupBy("item_id").agg(F.countDistinct("t", "i").alias("n_windows"))
    docs = candidates(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null"), each, anchors(benchmark), short)
    own = windows(docs, "doc_id", short).drop("m", "w")
    found = own.join(F.broadcast(items) if items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else items, "h")
    found = checkpointed(found)  # few rows, read again below; the windows of the documents are worked out once
    first = found.withColumn("item_windows", F.filter("item_windows", lambda x: ~x["b"])).where("not b and size(item_windows) > 0")
    # a window that stands several times on both sides is shared as often as it does on the side with fewer
    fewer = first.groupBy(*keys, "h").agg(F.least(F.countDistinct("t", "i"), F.max(F.size("item_windows")).cast("long")).alias("n"))
    shared = fewer.groupBy(*keys).agg(F.sum("n").alias("n_shared")).join(sizes, "item_id")
    pairs = first.where("slots is not null").select(*keys, "slots", F.explode(F.array_distinct(F.transform("item_windows", lambda x: x["theirs"]))).alias("theirs"))
    whole = checkpointed(judged(shared, pairs, keys))
    rest = found.join(whole, keys, "left_anti")
    met = rest.select(*keys, "t", "i", "slots", F.col("b").alias("mine"), F.explode("item_windows").alias("x")).select(*keys, "t", "i", "slots", "x.their_i", "x.their_t", "x.w", "x.theirs", (F.col("mine") | F.col("x.b")).alias("b"))
    fewer = met.groupBy(*keys, "w").agg(F.least(F.countDistinct("t", "i"), F.countDistinct("their_t", "their_i")).alias("n"))
    enough = fewer.groupBy(*keys).agg(F.sum("n").alias("n_shared")).join(sizes, "item_id").where(F.col("n_shared") >= SIMILARITY * F.col("n_windows"))
    met = checkpointed(met.join(enough, keys))
    places = checkpointed(occurrences(met))
    placed = [*keys, "t", "place"]
    one = judged(places.groupBy(*placed).agg(F.least(F.countDistinct("their_i"), F.countDistinct("i")).alias("n_shared"), F.first("n_windows").alias("n_windows")), places, placed).drop("t", "place")
    best = one.unionByName(judged(enough, met, keys)).groupBy(*keys).agg(F.max(F.struct("consistency", "n_shared", "n_windows", "share")).alias("m"))
    return whole.unionByName(best.select(*keys, "m.n_shared", "m.n_windows", "m.share", "m.consistency"))


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns; rows with a null id stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_WINDOWS = r"""
select {key}, array_to_string(c[i : i + 4], ' ') w,
       list_transform(c[i : i + 4], lambda x, k : case when x[1] = '<' then o[i + k - 1] end) s,
       list_contains(list_transform(c[i : i + 4], lambda x : x[1] = '<'), true) slotted, i
from (select {key}, list_transform(p, lambda x : x.c) c, list_transform(p, lambda x : x.o) o, unnest(range(1, greatest(len(p) - 4, 1) + 1)) i
      from (select {key}, list_filter(list_transform(words, lambda x, k : struct_pack(c := case
                when regexp_full_match(x, '[.!?\n]+') then '.'
                when regexp_full_match(x, '\d+([.,]\d+)*') then '<number>'
                when k > 1 and regexp_full_match(words[k - 1], '\d+([.,]\d+)*') and lower(x) in ({units}) then '<unit>'
                when k > 1 and regexp_full_match(x, '\p{Lu}\p{Ll}+') and not regexp_full_match(words[k - 1], '[.!?\n]+') then '<name>'
                else lower(x) end, o := x)), lambda x : x.c <> '.') p
            from (select {key}, regexp_extract_all(text, '\d+(?:[.,]\d+)*|[\p{L}\p{N}]+|[.!?\n]+') words from {table} where {key} is not null and text is not null))
      where len(p) > 0)"""
_SQL = f"""
with own as ({_WINDOWS.replace("{key}", "doc_id").replace("{table}", "documents").replace("{units}", _UNITS)}),
placed as (select distinct * from ({_WINDOWS.replace("{key}", "item_id").replace("{table}", "benchmark").replace("{units}", _UNITS)})),
theirs as (select distinct item_id, w, s, slotted from placed),
sizes as (select item_id, count(*) n_windows from placed group by item_id),
met as (select doc_id, item_id, w, own.slotted, own.s mine, theirs.s other from own join theirs using (w)),
shared as (select doc_id, item_id, sum(least(n, m)) :: bigint n_shared from (select doc_id, w, count(*) n from own group by all) join (select item_id, w, count(*) m from placed group by all) using (w) group by all),
vals as (select doc_id, item_id, a, b, count(*) n from (select doc_id, item_id, unnest(other) a, unnest(mine) b from met where slotted) where a is not null and b is not null group by all),
agree as (select doc_id, item_id, sum(case when best_b = b and best_a = a then n else 0 end) / sum(n) consistency
          from (select *, first(b) over (partition by doc_id, item_id, a order by n desc, b desc) best_b, first(a) over (partition by doc_id, item_id, b order by n desc, a desc) best_a from vals) group by all)
select doc_id, item_id, n_shared, n_windows, n_shared / n_windows share, coalesce(consistency, 1.0) :: double consistency
from shared join sizes using (item_id) left join agree using (doc_id, item_id)
where n_shared >= {SIMILARITY} * n_windows and coalesce(consistency, 1.0) >= {CONSISTENCY}"""

QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {"op10_decontaminate": _SQL}
