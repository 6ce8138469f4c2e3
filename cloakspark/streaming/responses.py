"""Responses of external processors as a stream: their manifests, each once, checked and sent one of two ways.

A response is a folder <root>/inbound/<domain>/<run> that is complete when its manifest is there. The file source notes
which manifests it has read, so a restart goes on with those that came since. A batch writes what it accepts and what
it rejects under its own number, in place of what an earlier try of it left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakspark.sources.exchange import content_hash
from cloakspark.sources.handoff import OPENED, content_digest, manifest_error, read_documents, read_table
from cloakspark.sources.session import checkpointed, with_package
from cloakspark.streaming.mapping import write_epoch

MANIFEST = "response_manifest.json"
FIELDS = "run_id string, domain string, status string, result_file string, result_sha256 string, processor string, processing_profile string, input_records long, output_records long"


def manifests(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of manifests: text, path."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", MANIFEST).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    return files.load(f"{root}/inbound").select("value", F.col("_metadata.file_path").alias("path"))


def checked(batch: DataFrame) -> DataFrame:
    """One row per manifest: its fields, domain and run by its place, result_path, found_sha256 and error (null if it is good).

    A text that is no JSON object has no fields, and is rejected for its run. batch: value, path.
    """
    parts = F.split("path", "/")
    rows = batch.select("path", F.from_json("value", FIELDS).alias("m"), F.get(parts, F.size(parts) - 3).alias("own_domain"), F.get(parts, F.size(parts) - 2).alias("own_run"))
    name = F.coalesce("m.result_file", F.lit(""))
    plain = ~name.isin("", ".", "..") & ~name.contains("/")
    rows = checkpointed(rows.withColumn("result_path", F.when(plain, F.concat(F.regexp_replace("path", r"/[^/]+$", "/"), name))))
    m = {k: F.col(f"m.{k}") for k in ("run_id", "domain", "status", "result_file", "result_sha256")}
    error = manifest_error(F.col("own_run"), F.col("own_domain"), m, F.col("found_sha256"))
    return _hashed(rows).select("own_domain", "own_run", "path", "result_path", "found_sha256", "m.*", error.alias("error"))


def _hashed(rows: DataFrame) -> DataFrame:
    """The rows with found_sha256, the hash of the result; null where there is none. Tasks read results as streams."""
    spark = rows.sparkSession
    first = rows.where("result_path is not null").select("result_path").first()
    if first is not None and first[0].partition(":")[0] not in OPENED:  # a store that only Spark reads: one manifest after the other
        pairs = [(r[0], content_hash(spark, r[0])) for r in rows.where("result_path is not null").select("result_path").distinct().toLocalIterator()]
        return rows.join(spark.createDataFrame(pairs, "result_path string, found_sha256 string"), "result_path", "left")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p and content_digest(p) for p in b.column("result_path").to_pylist()]
            yield b.append_column("found_sha256", pa.array(found, pa.string()))

    with_package(spark)
    small = rows.select("path", "result_path").mapInArrow(digests, "path string, result_path string, found_sha256 string")
    return rows.join(small.select("path", "found_sha256"), "path")


def sorted_responses(spark: SparkSession, root: str, accepted: str, rejected: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """All manifests that are there and weren't read before: good ones go to `accepted`, others to `rejected` with the first thing wrong."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = checkpointed(checked(batch))
        write_epoch(rows.where("error is null").drop("error"), accepted, epoch)
        write_epoch(rows.where("error is not null"), rejected, epoch)

    stream = manifests(spark, root, files_per_batch).writeStream.foreachBatch(each)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result_rows(spark: SparkSession, domain: str, result_path: str) -> DataFrame:
    """The records (structured) or texts of an accepted response."""
    return read_table(spark, result_path) if domain == "structured" else read_documents(spark, result_path).select(F.col("text").alias("content"))
