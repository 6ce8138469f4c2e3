"""Exchange with an external processor and the store: files, manifests, routes, envelopes, ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.functions import text as T
from cloakspark.sources.session import with_package


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all cells strings, blank ones as empty strings."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.na.fill("")


def read_table_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with inferred types, then as strings; blanks read as nan."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", True).csv(path)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in df.columns])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def newest_file(spark: SparkSession, path: str) -> str | None:
    """The path of the file modified last, null if there is none."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]


#: Bytes of a file that a task holds at once, and file systems whose streams a task can open itself.
PIECE = 8 << 20
OPENED = ("file", "hdfs", "s3", "gs")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)


def _digest(files: fs.FileSystem, path: str) -> str:
    """sha256 of a file, read piece by piece."""
    h = hashlib.sha256()
    with files.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE):
            h.update(piece)
    return h.hexdigest()


def content_digest(uri: str) -> str | None:
    """sha256 of a file; of a folder over those of its files in order of their names, or that of its only file; None where there is nothing."""
    files, path = _opened(uri)
    kind = files.get_file_info(path).type
    if kind == fs.FileType.File:
        return _digest(files, path)
    inside = files.get_file_info(fs.FileSelector(path)) if kind == fs.FileType.Directory else []
    hashes = [_digest(files, f.path) for f in sorted(inside, key=lambda f: f.base_name) if f.type == fs.FileType.File and f.base_name[0] not in "_."]
    return None if not hashes else hashes[0] if len(hashes) == 1 else hashlib.sha256("".join(hashes).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, name, sha256 of every file, of any length: tasks read files as streams.

    On file systems that only Spark can read, files are loaded whole, which ends at 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    first = files.select("path").first()
    if first is not None and first["path"].partition(":")[0] not in OPENED:
        return files.select("path", name, F.sha2("content", 256).alias("sha256"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("sha256", pa.array([_digest(*_opened(p)) for p in b.column("path").to_pylist()], pa.string()))

    with_package(spark)
    return files.select("path", name).mapInArrow(digests, "path string, name string, sha256 string")


def write_stage(df: DataFrame, path: str, domain: str, run_id: str, stage: str) -> None:
    """Replace the partition of a domain, run and stage; other partitions stay."""
    rows = df.withColumns({"domain": F.lit(domain), "run_id": F.lit(run_id), "stage": F.lit(stage)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "run_id", "stage").parquet(path)


def read_stage(spark: SparkSession, path: str, domain: str, run_id: str, stage: str = "final") -> DataFrame:
    """One partition of the store; an error if it has no rows."""
    rows = spark.read.parquet(path).where((F.col("domain") == domain) & (F.col("run_id") == run_id) & (F.col("stage") == stage))
    if rows.isEmpty():
        raise LookupError(f"no rows of {domain}, {run_id}, {stage}")
    return rows.drop("domain", "run_id", "stage")


def store_mapping(mapping: DataFrame, domain: str, run_id: str, stage: str, mode: str = "local", path: str | None = None, to_database: Callable[[DataFrame], None] | None = None) -> None:
    """Keep a mapping (placeholder and its value or ciphertext) of a stage: locally all stages, in the database only the final one; mode is local, db or both.

    `to_database` appends rows, for example by df.write.jdbc. Locally a stage that is written again replaces itself.
    """
    if mode not in ("local", "db", "both"):
        raise ValueError(f"mapping mode {mode!r} is none of local, db, both")
    if mode != "db":
        write_stage(mapping, path, domain, run_id, stage)
    if mode != "local" and stage == "final":
        rows = mapping.withColumns({"uuid": F.expr("uuid()"), "request_id": F.lit(run_id), "stage": F.lit(stage), "created_at": F.current_timestamp()})
        to_database(rows)


def read_mapping(spark: SparkSession, path: str, domain: str, run_id: str) -> DataFrame:
    """The final mapping of a run, with missing brackets added; an error if it has no rows."""
    return read_stage(spark, path, domain, run_id).withColumn("placeholder", T.bracketed(F.col("placeholder")))


def database_mapping(rows: DataFrame, run_id: str) -> DataFrame:
    """The final mapping of a run out of a table of the database (a filter that Spark pushes down), with missing brackets added; an error if it has no rows."""
    own = rows.where((F.col("request_id") == run_id) & (F.col("stage") == "final"))
    if own.isEmpty():
        raise LookupError(f"no final mapping of {run_id}")
    return own.withColumn("placeholder", T.bracketed(F.col("placeholder")))


def fetched(store: DataFrame, request_id: str, stage: str, table: str) -> DataFrame:
    """The rows of a request, stage and table."""
    return store.where((F.col("request_id") == request_id) & (F.col("stage") == stage) & (F.col("table_name") == table))


def bare(mapping: DataFrame) -> DataFrame:
    """Placeholders without brackets, as the plain store keeps them."""
    return mapping.withColumn("placeholder", F.btrim("placeholder", F.lit("<>")))


def route(mode: Column, rows: Column, threshold: Column, on_large: Column, text: bool = False) -> Column:
    """Where input goes: handoff, file_drop, skip, call or error. Only text input may be skipped for its size."""
    large = (mode == "lambda") & (rows > threshold)
    shared = F.array(F.lit("sftp_share"), F.lit("file_handoff"))
    skip = (mode == "skip") | (large & (on_large == "skip") if text else F.lit(False))
    return (
        F.when(F.array_contains(shared, mode) | (large & F.array_contains(shared, on_large)), "handoff")
        .when((mode == "file_drop") | (large & (on_large == "file_drop")), "file_drop").when(skip, "skip").when(mode == "lambda", "call").otherwise("error")
    )


def manifest_error(run_id: Column, domain: Column, m: dict[str, Column], file_hash: Column) -> Column:
    """The first thing wrong with a response manifest, null if it is good. file_hash: of the named file, null if missing."""
    name = F.coalesce(m["result_file"], F.lit(""))
    return (
        F.when(~m["run_id"].eqNullSafe(run_id), "run_id").when(~m["domain"].eqNullSafe(domain), "domain").when(~m["status"].eqNullSafe(F.lit("completed")), "status")
        .when((name == "") | name.contains("/") | name.isin(".", ".."), "result_file").when(file_hash.isNull(), "missing").when(~F.coalesce(m["result_sha256"] == file_hash, F.lit(False)), "sha256")
    )


def run_id_status(run_id: Column, reported: Column) -> Column:
    """Whether a payload reports the run it belongs to."""
    return F.when(reported == run_id, "matched").when(F.coalesce(reported, F.lit("")) != "", "mismatch").otherwise("absent")


def wrapped(df: DataFrame, run_id: Column, payload: str) -> DataFrame:
    """The frame with `envelope`: metadata with the run and its status, and the payload (JSON text)."""
    reported = F.get_json_object(payload, "$.run_id")
    meta = F.struct(run_id.alias("run_id"), run_id_status(run_id, reported).alias("third_party_run_id_status"), reported.alias("third_party_reported_run_id"))
    return df.withColumn("envelope", F.struct(meta.alias("gateway_metadata"), F.col(payload).alias("third_party_payload")))


def new_logs(logs: DataFrame, ledger: DataFrame) -> DataFrame:
    """name, sha256 of logs that no ledger entry includes. ledger: included_logs (array)."""
    seen = ledger.select(F.explode("included_logs").alias("name")).distinct()
    return logs.join(seen, "name", "left_anti")


def anchored(logs: DataFrame, ledger: DataFrame, bundle: str) -> DataFrame:
    """The ledger's next entry for the new logs: their names in order, a hash over their digests in order, a mock transaction over bundle and hash, a block number. No row without new logs."""
    new = new_logs(logs, ledger).agg(F.array_sort(F.collect_list("name")).alias("included_logs"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"))
    number = ledger.count() + 1
    tx = F.concat(F.lit("mock_"), F.sha2(F.concat_ws(":", F.lit(bundle), "sha256"), 256))
    return new.where(F.size("included_logs") > 0).select(F.lit(bundle).alias("zip_name"), "sha256", tx.alias("tx_hash"), F.lit(number).alias("block_number"), "included_logs")


def verified(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """zip_name, valid: a ledger entry is valid if its file is there with the recorded hash. files: name, sha256."""
    found = files.select(F.col("name").alias("zip_name"), F.col("sha256").alias("__hash"))
    return ledger.join(found, "zip_name", "left").select("zip_name", F.coalesce(F.col("sha256") == F.col("__hash"), F.lit(False)).alias("valid"))
