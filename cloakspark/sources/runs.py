"""A run: its settings at work, its counts out of its own writes, its phases' seconds, and its log.

Counts are observed while a frame is written, so no frame is planned a second time to be counted. What the
configuration says holds here: whether metrics are taken, whether artifacts get a sidecar, where mappings are kept
and whether their values are encrypted.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.operators import mapping as M
from cloakspark.operators.masking import masked_in_steps
from cloakspark.operators.rehydration import rehydrated
from cloakspark.sources import exchange as E
from cloakspark.sources import handoff as H
from cloakspark.sources.audit import Stopwatch, run_metrics, write_metrics
from cloakspark.sources.policy import RunConfig
from cloakspark.sources.session import checkpointed

log = logging.getLogger("cloakspark")


class _Lines(logging.Handler):
    """Keeps lines of a run: few, as they are about phases and not about rows."""

    def __init__(self):
        super().__init__()
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(name)s] %(message)s"))
        self.formatter.converter = time.gmtime
        self.lines: list[str] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


@contextmanager
def run_log(spark: SparkSession, folder: str, domain: str, run_id: str, level: str = "DEBUG", console: bool = False) -> Iterator[str]:
    """Lines of the package's logger, written as <folder>/<domain>_<time>_<run>.log when the run ends, also by an error. The path."""
    path = f"{folder}/{domain}_{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_{run_id}.log"
    kept, before = _Lines(), log.level
    handlers = [kept, *([logging.StreamHandler()] if console else [])]
    for h in handlers:
        log.addHandler(h)
    log.setLevel(level)
    try:
        log.info("run %s of %s begins", run_id, domain)
        yield path
        log.info("run %s of %s ends", run_id, domain)
    except BaseException as e:
        log.error("run %s of %s fails: %s: %s", run_id, domain, type(e).__name__, e)
        raise
    finally:
        for h in handlers:
            log.removeHandler(h)
        log.setLevel(before)
        E.write_text(spark, path, "\n".join(kept.lines) + "\n")


@dataclass
class Run:
    """What all steps of a run share."""

    spark: SparkSession
    domain: str
    folder: str
    config: RunConfig = field(default_factory=RunConfig)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    metadata: dict[str, Any] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    watch: Stopwatch = field(default_factory=Stopwatch)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """A phase, timed and logged."""
        log.debug("%s begins", name)
        try:
            with self.watch.phase(name):
                yield
        finally:
            log.debug("%s took %.3f s so far", name, self.watch.seconds[name])

    def written(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """`df` as Parquet under the run's folder, read again; counts (aggregates) come out of the write and are added to the run's."""
        path, said = f"{self.folder}/{name}", Observation()
        if self.config.metrics and counts:
            df = df.observe(said, *[c.alias(k) for k, c in counts.items()])
        df.write.mode("overwrite").parquet(path)
        if self.config.metrics and counts:
            for k, n in said.get.items():
                self.counts[k] = self.counts.get(k, 0) + (n or 0)
        if self.config.provenance:
            E.write_sidecar(self.spark, path, {"run_id": self.run_id, **self.metadata})
        log.info("%s written: %s", name, {k: self.counts.get(k) for k in counts})
        return self.spark.read.parquet(path)

    def keep_mapping(self, mapping: DataFrame, stage: str, key: Column | None = None, to_database: Callable[[DataFrame], None] | None = None) -> None:
        """The mapping where and how the configuration says: locally, in the database or both, its values encrypted with `key` or not."""
        if self.config.encrypt_mapping:
            if key is None:
                raise ValueError("the mapping is to be encrypted, and there is no key")
            mapping = M.encrypted(mapping.select("placeholder", "original_value"), key, self.config.mapping_key_id)
        H.store_mapping(mapping, self.domain, self.run_id, stage, self.config.mapping_mode, f"{self.folder}/mapping", to_database)

    def mapping(self, key: Column | None = None) -> DataFrame:
        """The final mapping of the run, decrypted where it was encrypted."""
        kept = H.read_mapping(self.spark, f"{self.folder}/mapping", self.domain, self.run_id)
        return M.decrypted(kept, key) if "ciphertext" in kept.columns else kept

    def report(self, **more: Any) -> dict[str, Any]:
        """All metrics by their labels, written to the run's folder; empty where the configuration wants none."""
        if not self.config.metrics:
            return {}
        waits = self.watch.seconds.get("waits", 0.0)
        seconds = dict(self.watch.seconds) | {"anonymization": max(0.0, sum(self.watch.seconds.get(k, 0.0) for k in ("static", "dynamic")) - waits), "rehydration": sum(self.watch.seconds.get(k, 0.0) for k in ("integrity", "restoring", "output"))}
        metrics = run_metrics(self.counts, seconds, **more)
        write_metrics(self.spark, metrics, {"run_id": self.run_id, **self.metadata}, f"{self.folder}/metrics_{self.run_id}")
        return metrics


def tokens_observed(*columns: str) -> Column:
    """How many placeholders the columns hold, as an aggregate."""
    return F.coalesce(F.sum(sum((F.coalesce(F.regexp_count(c, F.lit(P.PLACEHOLDER)), F.lit(0)) for c in columns), start=F.lit(0)).cast("long")), F.lit(0).cast("long"))


def masked_run(run: Run, docs: DataFrame, id_col: str, text_col: str, key: Column | None = None, to_database: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """Mask documents by the patterns, keep their mapping, and report: the masked documents and the metrics."""
    with run.phase("static"):
        trace = M.traced(docs, id_col, text_col, run.run_id)
        # texts and what was found in them come out of one write, with their counts
        kept = run.written(trace, "traced", records=F.count(F.lit(1)), detected=F.coalesce(F.sum(F.size("found")), F.lit(0)), expected=tokens_observed("text"))
        mapping = run.written(M.first_seen(M.found_of(kept, run.run_id)), "found", mappings=F.count(F.lit(1)))
        run.keep_mapping(mapping, "final", key, to_database)
    return kept.select(F.col("id").alias(id_col), F.col("text").alias(text_col)), run.report()


def restored_run(run: Run, payloads: DataFrame, id_col: str, json_col: str, expected: DataFrame, key: Column | None = None) -> tuple[DataFrame | None, dict[str, Any]]:
    """Restore returned payloads behind the gates of `rehydrated`: the rows, if there are any, and the metrics."""

    def retrieved() -> DataFrame:
        with run.phase("retrieval"):
            return checkpointed(run.mapping(key))

    with run.phase("end_to_end"):
        with run.phase("restoring"):
            said, rows = rehydrated(payloads, id_col, json_col, expected, retrieved, run.config.max_rehydration_passes)
        run.watch.seconds["restoring"] = max(0.0, run.watch.seconds["restoring"] - run.watch.seconds["retrieval"])
        if rows is not None:
            with run.phase("output"):
                rows = run.written(rows, "restored", records=F.count(F.lit(1)), passes=F.coalesce(F.max("passes"), F.lit(0)))
    summary = said.get("integrity", said)
    run.counts |= {k: int(summary.get(f"{k}_count") or 0) for k in ("expected", "returned", "missing", "unexpected")} | {"unresolved": int(said.get("unresolved") or 0)}
    log.info("restoration: %s", said)
    return rows, run.report(status=said.get("third_party_status", "processed"), rehydration=said["status"])
