"""Files for and from an external processor, on any file system that Spark can reach.

A request is complete when its manifest is there: data go to a folder of their own, which is renamed, and the manifest is
written last, also by renaming. Responses are read only after their manifest has been checked.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cloakspark.sources.handoff import file_hashes, manifest_error, read_documents, read_table
from cloakspark.sources.policy import RunConfig


class HandoffError(RuntimeError):
    """A response that can't be accepted, or that didn't come in time."""


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path on it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; what stands at the target goes."""
    fs, to = _path(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to):
        fs.delete(to, True)
    if not fs.rename(_path(spark, source)[1], to):
        raise OSError(f"can't rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, written beside its place and renamed."""
    fs, p = _path(spark, f"{path}.writing")
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    moved(spark, f"{path}.writing", path)


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """The object in a small JSON file."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold an object")
    return value


def now() -> str:
    return datetime.now(UTC).isoformat()


def write_sidecar(spark: SparkSession, path: str, metadata: dict[str, Any], **extra: Any) -> None:
    """What an artifact is, beside it, as <path>.metadata.json."""
    write_text(spark, f"{path}.metadata.json", json.dumps({**metadata, "artifact": path.rstrip("/").rpartition("/")[2], "created_at_utc": now(), **extra}, indent=2))


def write_report(spark: SparkSession, path: str, metadata: dict[str, Any], report: dict[str, Any]) -> None:
    """A report as JSON, with its sidecar."""
    write_text(spark, path, json.dumps({**metadata, **report}, indent=2, default=str))
    write_sidecar(spark, path, metadata)


def write_table(df: DataFrame, path: str, metadata: dict[str, Any]) -> None:
    """A stage of a table as CSV files with header, with its sidecar."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    write_sidecar(df.sparkSession, path, metadata)


def write_texts(df: DataFrame, id_col: str, text_col: str, path: str, metadata: dict[str, Any], rows_per_file: int = 10_000) -> None:
    """A stage of documents as JSON lines of id and text, in files of bounded size, with one sidecar for all."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)
    write_sidecar(df.sparkSession, path, metadata)


def read_texts(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """id, text of a stage of documents."""
    return spark.read.schema(f"id {id_type}, text string").json(path)


def content_hash(spark: SparkSession, path: str) -> str | None:
    """sha256 of a file; of a folder over the hashes of its files in order of their names. None where there is nothing."""
    if not exists(spark, path):
        return None
    hashes = file_hashes(spark, path).where(~F.col("name").startswith("_")).orderBy("name")
    n, only, whole = 0, None, hashlib.sha256()
    for r in hashes.toLocalIterator():  # a line per file, a part of them at a time
        n, only = n + 1, r["sha256"]
        whole.update(only.encode())
    return None if not n else only if n == 1 else whole.hexdigest()


def publish(df: DataFrame, root: str, domain: str, run_id: str, metadata: dict[str, Any], profile: str = "risk_enrichment") -> str:
    """Write a request for an external processor: a table (structured) or texts; the folder it is in. df: the masked rows.

    The number of records is counted by the write itself.
    """
    spark, out = df.sparkSession, f"{root}/outbound/{domain}/{run_id}"
    name = "anonymized.csv" if domain == "structured" else "anonymized.txt"
    said = Observation()
    writer = df.observe(said, F.count(F.lit(1)).alias("records")).write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(f"{out}/.writing") if domain == "structured" else writer.text(f"{out}/.writing")
    moved(spark, f"{out}/.writing", f"{out}/{name}")
    form = "csv" if domain == "structured" else "text"
    manifest = {**metadata, "domain": domain, "format": form, "input_file": name, "input_sha256": content_hash(spark, f"{out}/{name}"), "records": said.get["records"], "processing_profile": profile, "created_at_utc": now()}
    write_text(spark, f"{out}/request_manifest.json", json.dumps(manifest, indent=2))
    return out


def awaited(spark: SparkSession, root: str, domain: str, run_id: str, config: RunConfig, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> str:
    """The folder of a response, once its manifest is there; HandoffError after the configured time."""
    folder, end = f"{root}/inbound/{domain}/{run_id}", clock() + max(0.0, config.timeout_seconds)
    while not exists(spark, f"{folder}/response_manifest.json"):
        if clock() >= end:
            raise HandoffError(f"no response for {domain} {run_id} in {folder}")
        sleep(max(0.1, config.poll_seconds))
    return folder


def accepted(spark: SparkSession, folder: str, domain: str, run_id: str) -> tuple[dict[str, Any], DataFrame]:
    """What a response's manifest says, and its records (structured) or texts; HandoffError, by the first thing wrong, if it can't be accepted."""
    manifest = read_json(spark, f"{folder}/response_manifest.json")
    name = str(manifest.get("result_file") or "")
    plain = name not in ("", ".", "..") and "/" not in name
    found = content_hash(spark, f"{folder}/{name}") if plain else None
    said = {k: F.lit(None if manifest.get(k) is None else str(manifest[k])) for k in ("run_id", "domain", "status", "result_file", "result_sha256")}
    if wrong := spark.range(1).select(manifest_error(F.lit(run_id), F.lit(domain), said, F.lit(found)).alias("e")).first()["e"]:
        raise HandoffError(f"response of {domain} {run_id}: {wrong} is wrong")
    common = {"run_id": manifest["run_id"], "status": "processed", "processor": manifest.get("processor", "external-processor"), "processing_profile": manifest.get("processing_profile", "risk_enrichment")}
    common |= {k: manifest.get(k) for k in ("input_records", "output_records")}
    rows = read_table(spark, f"{folder}/{name}") if domain == "structured" else read_documents(spark, f"{folder}/{name}").select(F.col("text").alias("content"))
    return common, rows


#: What is said in place of a result: status, note.
CONTROL = {
    "pending": ("file_drop", "The request was published; its result is not waited for."),
    "file_drop": ("file_drop", "Masked data is prepared for an external processor; none was called."),
    "skip": ("skipped", "External processing was skipped by configuration."),
}


def control_result(kind: str, run_id: str, **more: Any) -> dict[str, Any]:
    """The payload that stands for the result of a request that wasn't processed: pending, file_drop or skip."""
    status, note = CONTROL[kind]
    return {"run_id": run_id, "status": status, **more, "note": note}


def exchanged(df: DataFrame, root: str, domain: str, run_id: str, metadata: dict[str, Any], config: RunConfig, way: str, call: Callable[[DataFrame], DataFrame] | None = None, **waiting) -> tuple[dict[str, Any], DataFrame | None]:
    """Send masked rows the given way (of `handoff.route`): what is said of the result, and its rows, None where there are none.

    `call` is the remote processor of the way "call"; it takes the rows and gives rows.
    """
    if way == "call" and call is not None:
        return {"run_id": run_id, "status": "processed"}, call(df)
    if way in ("skip", "file_drop"):
        return control_result(way, run_id, records=df.count()), None
    if way != "handoff":
        raise ValueError(f"no way {way!r} to an external processor")
    out = publish(df, root, domain, run_id, metadata)
    if not config.wait_for_result:
        return control_result("pending", run_id, handoff_directory=out), None
    return accepted(df.sparkSession, awaited(df.sparkSession, root, domain, run_id, config, **waiting), domain, run_id)


def unwrapped(text: Column) -> Column:
    """The payload in an envelope of `handoff.wrapped` or in the body of a remote reply (an object, or one as a string); any other text as it is."""
    payload = F.coalesce(F.get_json_object(text, "$.third_party_payload"), text)
    return F.coalesce(F.get_json_object(payload, "$.body"), payload)


def input_path(spark: SparkSession, folder: str, domain: str) -> str:
    """The input of a domain in a folder: the table's CSV, or the newest text; an error says what is expected."""
    fs, p = _path(spark, f"{folder}/{'*.csv' if domain == 'structured' else '*.txt'}")
    files = sorted([(f.getModificationTime(), f.getPath().toString()) for f in fs.globStatus(p) or []])
    if not files:
        raise FileNotFoundError(f"{domain} input is read from a {'CSV' if domain == 'structured' else 'text'} file in {folder}; there is none")
    return files[-1][1]


def logs_of(spark: SparkSession, folder: str, current: str | None = None) -> list[str]:
    """The current log if it exists, else all logs of a folder, the oldest first."""
    if current and exists(spark, current):
        return [current]
    fs, p = _path(spark, f"{folder}/*.log")
    return [path for _, path in sorted([(f.getModificationTime(), f.getPath().toString()) for f in fs.globStatus(p) or []])]
