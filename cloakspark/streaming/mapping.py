"""A mapping that holds over a whole stream: first-seen values, and tokens of their own for values whose hashes collide.

Every batch's values meet the table of what was given out before. A value that has a token keeps it; new values are
settled among themselves and against the tokens that are taken. The table grows by one version per batch, a folder named
by the batch's number that is written whole before the batch's texts, so a batch that is done again after a failure
reads the same state and writes the same rows in place of those of its first try.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators.mapping import found_in
from cloakspark.operators.masking import masked_in_steps
from cloakspark.sources.exchange import exists
from cloakspark.sources.session import checkpointed, stored

STATE = "label string, norm string, raw string, placeholder string, hash string"


def known_before(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """What batches before this one gave out; what a later batch, or an earlier try of this one, has written is left out."""
    if not exists(spark, folder):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(f"{STATE}, epoch long").parquet(folder).where(F.col("epoch") < epoch).drop("epoch")


def settled(found: DataFrame, known: DataFrame, run_id: str, digits: int = 10) -> DataFrame:
    """label, norm, raw, placeholder, hash of the values of a batch that have no token yet. found: label, raw, ord; known: STATE.

    As if the batch's values came in order of `ord`: each new one takes the first free one of its plain hash and the hashes
    with 1, 2, ...; tokens of `known` are never free. raw is the value as it was seen first; hash is its plain hash.
    """
    firsts = found.groupBy(T.label_norm(F.col("label")).alias("label"), T.value_norm(F.col("raw")).alias("norm")).agg(F.min(F.struct("ord", "raw")).alias("first"))
    new = firsts.join(known.select("label", "norm"), ["label", "norm"], "left_anti")
    plain = T.placeholder(run_id, F.col("label"), F.col("norm"), digits=digits)
    keys = stored(new.select("label", "norm", F.col("first.ord").alias("ord"), F.col("first.raw").alias("raw"), F.lit(0).alias("k"), plain.alias("hash")))
    both = keys.select("label").unionAll(known.select("label")).groupBy("label").count()
    if not both.where(F.col("count") > 16**digits).isEmpty():
        raise ValueError(f"more values of a label than tokens of {digits} digits")
    taken = known.select("placeholder").distinct().withColumn("old", F.lit(True))
    own = F.struct("ord", "label", "norm")
    while True:
        extra = F.when(F.col("k") > 0, F.col("k").cast("string"))
        tried = keys.withColumn("placeholder", T.placeholder(run_id, F.col("label"), F.col("norm"), extra, digits))
        met = tried.groupBy("placeholder").agg(F.min(own).alias("owner"), F.count("*").alias("n")).join(taken, "placeholder", "left")
        lost = stored(met.where("old or n > 1"))
        if lost.isEmpty():
            return tried.select("label", "norm", "raw", "placeholder", "hash")
        moved = (F.col("n").isNotNull() & (F.coalesce("old", F.lit(False)) | (F.col("owner") != own))).cast("int")
        keys = stored(tried.join(lost, "placeholder", "left").withColumn("k", F.col("k") + moved).select("label", "norm", "ord", "raw", "k", "hash"))


def masked_with(df: DataFrame, text_col: str, run_id: str, mapping: DataFrame, digits: int = 10, rules=P.TEXT_PATTERNS) -> DataFrame:
    """`df` masked by the patterns, with the tokens of the mapping where a value's plain hash was taken. mapping: STATE.

    Only values whose token isn't their plain hash matter here: they are few, and texts that hold none of their plain
    hashes stay as plain masking leaves them.
    """
    if mapping.where("placeholder <> hash").isEmpty():
        return masked_in_steps(df, text_col, run_id, rules)
    moved = checkpointed(mapping.where("placeholder <> hash").select("label", "norm", "placeholder"))
    return _masked_moved(df, text_col, run_id, moved, digits, rules)


def _masked_moved(df: DataFrame, text_col: str, run_id: str, moved: DataFrame, digits: int, rules) -> DataFrame:
    """Pattern by pattern: matches are joined with the moved values of the pattern's label, and stitched in."""
    names = df.columns
    rows = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    for label, pattern in rules:
        own = moved.where(F.col("label") == T.label_norm(F.lit(label)))
        java = F.lit(P.java(pattern))
        each = rows.select("__row", F.posexplode_outer(F.regexp_extract_all(text_col, java, 0)).alias("at", "m")).where("m is not null")
        tokens = each.join(own.select("norm", "placeholder"), T.value_norm(F.col("m")) == F.col("norm"), "left")
        token = F.when(T.is_token(F.col("m")), F.col("m")).otherwise(F.coalesce("placeholder", T.placeholder(run_id, label, F.col("m"), digits=digits)))
        put = tokens.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", token.alias("t")))), lambda x: x["t"]).alias("__put"))
        gaps = F.split(text_col, java, -1)
        new = F.array_join(F.zip_with(gaps, "__put", lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
        rows = checkpointed(rows.join(put, "__row", "left").withColumn(text_col, F.when(F.col("__put").isNull(), F.col(text_col)).otherwise(new)).select(*names, "__row"))
    return rows.select(*names)


def mask_stream(spark: SparkSession, path: str, schema: StructType, id_col: str, text_col: str, run_id: str, out: str, store: str, checkpoint: str, files_per_batch: int = 1000, digits: int = 10) -> StreamingQuery:
    """Mask the files that are there, batch by batch, with one mapping for all of the stream; a restart goes on where it ended.

    out: the masked rows, a partition `epoch` per batch. store: the mapping (STATE), in the same way. Values found by a
    pattern are those in the text that the patterns before it left by plain hashes.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        batch = checkpointed(batch)
        known = known_before(spark, store, epoch)
        new = settled(found_in(batch, id_col, text_col, run_id), known, run_id, digits)
        write_epoch(new, store, epoch)
        written = spark.read.schema(STATE).parquet(f"{store}/epoch={epoch}")
        write_epoch(masked_with(batch, text_col, run_id, known.unionByName(written), digits), out, epoch)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_epoch(rows: DataFrame, folder: str, epoch: int) -> None:
    """The rows of a batch, in place of what an earlier try of it left."""
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
