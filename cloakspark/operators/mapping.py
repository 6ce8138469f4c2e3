"""The token-to-value mapping: build, collisions, store and integrity. Restoration is in `restoration`, its graph in `cycles`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.sources.session import stored


class IntegrityError(ValueError):
    """Returned data holds tokens that it must not hold."""


def first_seen(found: DataFrame) -> DataFrame:
    """placeholder, original_value: of each placeholder the value seen first. found: placeholder, raw, ord (any ordered type)."""
    return found.groupBy("placeholder").agg(F.min_by("raw", F.struct("ord", "raw")).alias("original_value"))


def traced(df: DataFrame, id_col: str, text_col: str, run_id: str, rules=P.TEXT_PATTERNS) -> DataFrame:
    """id, text (masked), found: what each pattern matched, coded, in the text that the patterns before it left."""
    from cloakspark.operators.masking import masked_text

    # matches travel as text: the optimiser would read fields of structs by working out the whole chain for each field
    def coded(label: str, rule: int):
        return lambda m, i: F.concat_ws("\x01", F.lit(label), F.lit(str(rule)), i.cast("string"), m)

    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<string>").alias("found"))
    needs = F.col("text").rlike(P.java(P.TEXT_NEEDS)) if rules in (P.TEXT_PATTERNS, P.ASCII_TEXT_PATTERNS) else F.col("text").isNotNull()
    df = df.withColumn("any", needs)
    for k, (label, pattern) in enumerate(rules):  # one projection per pattern, as each reads what the one before left
        matches = F.when(F.col("any"), F.transform(F.regexp_extract_all("text", F.lit(P.java(pattern)), 0), coded(label, k)))
        text = F.when(F.col("any"), masked_text(F.col("text"), run_id, label, pattern)).otherwise(F.col("text"))
        df = df.select("id", text.alias("text"), F.when(F.col("any"), F.concat("found", matches)).otherwise(F.col("found")).alias("found"), "any")
    return df.drop("any")


def found_of(trace: DataFrame, run_id: str) -> DataFrame:
    """placeholder, label, raw, ord of all that `traced` found."""
    rows = trace.select("id", F.explode_outer("found").alias("m")).where("m is not null").select("id", F.split("m", "\x01", 4).alias("m"))
    label, raw = F.col("m")[0], F.col("m")[3]
    return rows.select(T.placeholder(run_id, label, raw).alias("placeholder"), label.alias("label"), raw.alias("raw"), F.struct("id", F.col("m")[1].cast("int").alias("rule"), F.col("m")[2].cast("int").alias("at")).alias("ord"))


def found_in(df: DataFrame, id_col: str, text_col: str, run_id: str, rules=P.TEXT_PATTERNS) -> DataFrame:
    """placeholder, label, raw, ord of every match of the patterns, each in the text that the patterns before it left."""
    return found_of(traced(df.where(F.col(text_col).rlike(P.java(P.TEXT_NEEDS))), id_col, text_col, run_id, rules), run_id)


#: Tokens that a value looks at in a round.
AHEAD = 32


def resolved_collisions(found: DataFrame, run_id: str, digits: int = 10, tries: int | None = None) -> DataFrame:
    """label, norm, placeholder: one placeholder per (label, normalised value), also where hashes collide.

    As if values were given tokens in order of `ord`, each the first free one of the plain hash and the hashes with 1, 2, ...
    In every round the earliest value of a shared token keeps it and the others go on to the first of their next ones that no
    earlier value has, until no token is shared; as every token prefers the earliest, the result is that of the sequence.
    Only values without a token look ahead in a round. `tries` bounds the tokens that a value may try: one that finds none
    among them has a null placeholder. Without it, it is an error if a label has more values than there are tokens; with it,
    values later than all owners give up as soon as all tokens of their label have owners. found: label, raw, ord.
    """
    keys = found.groupBy(T.label_norm(F.col("label")).alias("label"), T.value_norm(F.col("raw")).alias("norm")).agg(F.min("ord").alias("ord")).withColumn("k", F.lit(0))
    keys = stored(keys)
    if tries is None and keys.groupBy("label").count().where(F.col("count") > 16**digits).limit(1).count():
        raise ValueError(f"more values of a label than tokens of {digits} digits")
    own = F.struct("ord", "label", "norm")
    token = T.placeholder(run_id, F.col("label"), F.col("norm"), F.when(F.col("k") > 0, F.col("k").cast("string")), digits)
    without = []
    while True:
        keys = keys.select("label", "norm", "ord", "k", token.alias("placeholder"))
        owners = stored(keys.groupBy("label", "placeholder").agg(F.count("*").alias("n"), F.min(own).alias("owner")))
        if owners.where("n > 1").isEmpty():
            return reduce(DataFrame.union, without, keys.select("label", "norm", "placeholder"))
        state = keys.join(owners.where("n > 1").select("placeholder", "owner"), "placeholder", "left").withColumn("loses", F.coalesce(F.col("owner") != own, F.lit(False))).drop("owner", "placeholder")
        end = F.col("k") + AHEAD
        if tries is None:
            state = state.withColumn("gone", F.lit(False))
        else:
            last = owners.groupBy("label").agg(F.count("*").alias("n"), F.max("owner").alias("last")).where(F.col("n") == 16**digits).drop("n")
            gone = F.col("loses") & ((F.col("k") + 1 >= tries) | F.coalesce(own > F.col("last"), F.lit(False)))
            state, end = state.join(last, "label", "left").withColumn("gone", gone).drop("last"), F.least(end, F.lit(tries - 1))
        state = stored(state)
        if tries is not None:
            without.append(state.where("gone").select("label", "norm", F.lit(None).cast("string").alias("placeholder")))
        ahead = state.where("loses and not gone").select("label", "norm", "ord", F.explode(F.sequence(F.col("k") + 1, end)).alias("k"))
        tried = ahead.withColumn("placeholder", token).join(owners.select("placeholder", "owner"), "placeholder", "left")
        free = F.col("owner").isNull() | (own < F.col("owner"))
        # where none is free the last one looked at is lost in the next round
        further = tried.groupBy("label", "norm", "ord").agg(F.coalesce(F.min(F.when(free, F.col("k"))), F.max("k")).alias("k"))
        keys = stored(state.where("not loses").select("label", "norm", "ord", "k").unionByName(further))


def upserted(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The store with all rows of the given keys replaced: old ones go, then the new are added."""
    return store.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def latest_request(store: DataFrame, stage: str, table: str) -> DataFrame:
    """request_id of the newest row of a stage and table."""
    return store.where((F.col("stage") == stage) & (F.col("table_name") == table)).agg(F.max_by("request_id", F.struct("created_at", "request_id")).alias("request_id"))


def token_counts(df: DataFrame, *columns: str) -> DataFrame:
    """placeholder, n over the named text columns."""
    tokens = F.flatten(F.array(*[T.tokens_in(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    # outer, so that no filter on the tokens is pushed below the projections that make the text
    return df.select(F.explode_outer(tokens).alias("placeholder")).where("placeholder is not null").groupBy("placeholder").agg(F.count("*").alias("n"))


def integrity(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """placeholder, expected, returned, status (ok, missing, unexpected) of all tokens on either side. Inputs: placeholder, n."""
    both = expected.select("placeholder", F.col("n").alias("expected")).join(returned.select("placeholder", F.col("n").alias("returned")), "placeholder", "full_outer")
    e, r = F.coalesce("expected", F.lit(0)), F.coalesce("returned", F.lit(0))
    return both.select("placeholder", e.alias("expected"), r.alias("returned"), F.when(r > e, "unexpected").when(r < e, "missing").otherwise("ok").alias("status"))


def integrity_summary(report: DataFrame) -> DataFrame:
    """One row: distinct tokens expected, returned, missing and unexpected, and whether restoration may go on (fewer is allowed, more is not)."""
    unexpected = F.count_if(F.col("status") == "unexpected")
    return report.agg(
        F.count_if(F.col("expected") > 0).alias("expected_count"), F.count_if(F.col("returned") > 0).alias("returned_count"), F.count_if(F.col("status") == "missing").alias("missing_count"),
        unexpected.alias("unexpected_count"), F.when(unexpected > 0, "failed").otherwise("passed").alias("status"),
    )


def integrity_lists(report: DataFrame) -> DataFrame:
    """status, placeholder of the missing and unexpected tokens, in order: rows, as there may be very many."""
    return report.where("status <> 'ok'").select("status", "placeholder").orderBy("status", "placeholder")


def check_integrity(report: DataFrame) -> None:
    """Raise IntegrityError if any token came back more often than it went out."""
    if n := integrity_summary(report).first()["unexpected_count"]:
        raise IntegrityError(f"{n} tokens were returned more often than sent")


def unresolved(df: DataFrame, text_col: str) -> DataFrame:
    """n: tokens left in all texts."""
    return df.agg(F.coalesce(F.sum(F.regexp_count(text_col, F.lit(P.PLACEHOLDER))), F.lit(0)).alias("n"))


def check_resolved(df: DataFrame, text_col: str) -> None:
    """Raise IntegrityError if a token is left; no partial output is to be written."""
    if n := unresolved(df, text_col).first()["n"]:
        raise IntegrityError(f"{n} tokens are unresolved")


def plain_restored(text: Column, entries: Column) -> Column:
    """One pass by plain substring, the longest token first, with and without brackets. entries: array<struct<placeholder, original>>."""
    ordered = F.array_sort(entries, lambda a, b: F.when(F.length(a["placeholder"]) != F.length(b["placeholder"]), F.length(b["placeholder"]) - F.length(a["placeholder"])).when(a["placeholder"] < b["placeholder"], -1).when(a["placeholder"] > b["placeholder"], 1).otherwise(0))

    def one(t: Column, e: Column) -> Column:
        bare, value = F.btrim(e["placeholder"], F.lit("<>")), F.btrim(e["original"], F.lit("<>"))
        return F.replace(F.replace(t, F.concat(F.lit("<"), bare, F.lit(">")), value), bare, value)

    return F.aggregate(ordered, text, one)


def encrypted(mapping: DataFrame, key: Column, key_id: str = "") -> DataFrame:
    """original_value as ciphertext, wrapped_key and key_id: a data key of its own for every value, itself encrypted with `key`.

    AES-GCM with a random nonce for both, in base64. Equal values have different ciphertexts.
    """
    # the data key is random: a projection of its own, so that both columns below read the same one
    keyed = mapping.withColumn("__data_key", F.unhex(F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))))
    sealed = lambda value, with_: F.base64(F.aes_encrypt(value, with_, F.lit("GCM")))
    both = keyed.withColumns({"ciphertext": sealed(F.col("original_value").cast("binary"), F.col("__data_key")), "wrapped_key": sealed(F.col("__data_key"), key), "key_id": F.lit(key_id)})
    return both.drop("original_value", "__data_key")


def decrypted(mapping: DataFrame, key: Column) -> DataFrame:
    """The inverse of `encrypted`. A ciphertext that isn't one (no base64, or null) and one that doesn't fit its key are two different errors."""
    whole = F.when(F.col("ciphertext").isNotNull() & F.col("wrapped_key").isNotNull() & F.col("ciphertext").rlike("^[A-Za-z0-9+/\\r\\n]+=*$"), F.col("ciphertext"))
    text = F.coalesce(whole, F.raise_error(F.concat(F.lit("no ciphertext for "), F.col("placeholder"))).cast("string"))
    data_key = F.aes_decrypt(F.unbase64("wrapped_key"), key, F.lit("GCM"))
    return mapping.withColumn("original_value", F.aes_decrypt(F.unbase64(text), data_key, F.lit("GCM")).cast("string")).drop("ciphertext", "wrapped_key", "key_id")


def key_works(spark, key: Column) -> bool:
    """Whether a key encrypts and decrypts a probe."""
    probe = spark.createDataFrame([("<PROBE_0>", "probe")], "placeholder string, original_value string")
    return decrypted(encrypted(probe, key), key).first()["original_value"] == "probe"
