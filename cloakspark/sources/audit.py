"""Run metrics, artifact records and log bundles."""

from __future__ import annotations

import hashlib
import json
import os
import time
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.sources.exchange import write_text
from cloakspark.sources.policy import RunConfig


class Stopwatch:
    """Seconds by phase, adding up; waits for others (a provider, a rate limit) are a phase of their own and can be left out."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.seconds = clock, defaultdict(float)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.seconds[name] += self.clock() - began

    def without_waits(self, *names: str) -> float:
        """Seconds of some phases, less the waits."""
        return max(0.0, sum(self.seconds[n] for n in names) - self.seconds["waits"])


#: Fixed labels of the metrics: of counts, of times, and of fidelity.
COUNTS = {
    "records": "Records", "detected": "Sensitive values detected", "mappings": "Mappings created", "residual": "Residual PII findings", "recovery_rows": "Contextual recovery rows", "recovery_values": "Recovery values detected",
    "expected": "Expected placeholders", "returned": "Returned placeholders", "missing": "Processor omitted placeholders", "unexpected": "Unexpected placeholders", "unresolved": "Unresolved placeholders", "passes": "Rehydration passes",
}
TIMES = {
    "anonymization": "Anonymization", "rehydration": "Core rehydration (excluding mapping retrieval)", "static": "Static anonymization", "inference": "LLM inference", "replacement": "Dynamic replacement", "waits": "Excluded provider waits",
    "integrity": "Rehydration integrity", "retrieval": "Mapping retrieval/decryption", "end_to_end": "End-to-end rehydration", "restoring": "Placeholder replacement", "output": "Rehydration output",
}
FIDELITY = {"exact_field_fidelity": "Exact field fidelity", "semantic_field_fidelity": "Semantic field fidelity", "fields_changed": "Fields changed", "rows_changed": "Rows changed"}
#: Statuses of processing after which nothing is restored.
NOT_RESTORED = frozenset(("failed", "file_drop", "skipped"))


def restoration_fidelity(status: str, unresolved: int, unexpected: int) -> str:
    """100% if nothing is left and nothing was added; not applicable where nothing was restored."""
    return "Not applicable" if status in NOT_RESTORED else "Incomplete" if unresolved or unexpected else "100%"


def run_metrics(counts: dict[str, int], seconds: dict[str, float], status: str = "processed", rehydration: str = "completed", validation: str = "not_run", fidelity: dict[str, str] | None = None) -> dict[str, Any]:
    """All metrics of a run by their labels. Counts that are not given are 0, times that are not given are left out, but for the two that every run has."""
    times = {"anonymization": 0.0, "rehydration": 0.0} | seconds
    kept = {k: v for k, v in counts.items() if k not in COUNTS}
    numbers = {label: counts.get(k, 0) for k, label in COUNTS.items() if k != "passes" or "passes" in counts}
    said = {"Third-party processing": status, "Rehydration status": rehydration, "Anonymization validation": validation, "Placeholder restoration fidelity": restoration_fidelity(status, counts.get("unresolved", 0), counts.get("unexpected", 0))}
    timed = {TIMES.get(k, k): f"{v:.3f}s" for k, v in times.items()}
    return numbers | kept | said | timed | ({label: fidelity.get(k, "Not applicable") for k, label in FIDELITY.items()} if fidelity else {})


def write_metrics(spark: SparkSession, metrics: dict[str, Any], metadata: dict[str, str], path: str) -> None:
    """As JSON, and as an aligned table beside it, on any file system that Spark can reach."""
    write_text(spark, f"{path}.json", json.dumps({**metadata, "metrics": metrics}, indent=2))
    write_text(spark, f"{path}.txt", "".join(f"{k:<50} {v}\n" for k, v in {"Metric": "Value", **metrics}.items()))


def record_artifact(spark: SparkSession, table: str, path: str, metadata: dict[str, str], **extra: str) -> None:
    """Append a row about an artifact."""
    rows = spark.createDataFrame([(path, json.dumps({**metadata, **extra}, sort_keys=True))], "artifact string, metadata string")
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(table)


def bundled(logs: list[str], path: str) -> dict[str, Any]:
    """Zip the logs; the bundle's name, path, hash and what is in it."""
    if not logs:
        raise ValueError("there are no logs to bundle")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for log in sorted(logs):
            z.write(log, arcname=f"logs/{os.path.basename(log)}")
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    return {"zip_name": os.path.basename(path), "zip_path": path, "sha256": digest, "included_logs": sorted(map(os.path.basename, logs))}


#: Fixed fields of a ledger entry.
LEDGER = (
    "run_id string, policy_id string, policy_version string, policy_hash string, domain string, bundle_type string, zip_name string, zip_path string, sha256 string, included_logs array<string>, "
    "blockchain_enabled boolean, blockchain_anchor_digest boolean, blockchain_provider string, blockchain_tx_hash string, blockchain_block_number long, blockchain_rpc_url string, timestamp_utc string, note string"
)


def ledger_entry(bundle: dict[str, Any], metadata: dict[str, str], domain: str, config: RunConfig, anchor: Callable[[str], dict[str, Any]] | None = None) -> dict[str, Any]:
    """The whole entry of a bundle. `anchor` takes a digest to where it can't be changed and gives tx_hash, block_number and rpc_url."""
    receipt = anchor(bundle["sha256"]) if config.anchor_ledger and anchor else {}
    chain = {"blockchain_enabled": config.anchor_ledger, "blockchain_anchor_digest": config.anchor_ledger, "blockchain_provider": config.anchor_provider}
    chain |= {f"blockchain_{k}": receipt.get(k) for k in ("tx_hash", "block_number", "rpc_url")}
    return {**metadata, "domain": domain, "bundle_type": "run_logs", **bundle, **chain, "timestamp_utc": datetime.now(UTC).isoformat(), "note": "Logs are bundled and hashed here; only the digest is anchored."}


def appended(spark: SparkSession, ledger: str, entry: dict[str, Any]) -> None:
    """Append an entry to the ledger table; fields that it lacks are null."""
    names = spark.createDataFrame([], LEDGER).columns
    spark.createDataFrame([tuple(entry.get(n) for n in names)], LEDGER).write.mode("append").parquet(ledger)


def audited(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """zip_name, exists, valid for every entry. files: name, sha256."""
    found = files.select(F.col("name").alias("zip_name"), F.col("sha256").alias("__hash"))
    return ledger.join(found, "zip_name", "left").select("zip_name", F.col("__hash").isNotNull().alias("exists"), F.coalesce(F.col("sha256") == F.col("__hash"), F.lit(False)).alias("valid"))
