"""What the operators share: table access, Arrow batches and shared checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be very long, so batches stay small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the rows of an Arrow batch, so that a worker holds few long texts at once.

    Workers get the folder of this package as PYTHONPATH; where executors don't have it, ship it with --py-files.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, env["PYTHONPATH"]]) if env.get("PYTHONPATH") else root


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, one of our own in local mode, and elsewhere an error, as hosts must share it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        named = tempfile.mkdtemp(prefix="cloakspark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder, where every executor can read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with state: `make` runs once per task and returns the function of a batch."""
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def held_out(doc_id: str, modulus: int, rest: int):
    """True where crc32 of the id as text leaves `rest` by `modulus`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def ascii_lower(c):
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled(spark: SparkSession, sf_dir: str, label: str, modulus: int, rest: int, bound: int) -> DataFrame:
    """doc_id, text, y: at most `bound` labelled documents outside the held-out fold.

    The `bound` labels with the smallest hash of their id are taken, so every size is sampled alike. A document
    with several label rows counts once, by the largest; null labels and null ids are left out. As the labels
    are at most `bound` rows, they are broadcast to the documents.
    """
    fold = table(spark, sf_dir, "labels").where(~held_out("doc_id", modulus, rest)).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    some = fold.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as string) text")
    return docs.join(F.broadcast(some), "doc_id")
