"""Restoration of what an external processor returned, behind its gates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspark.operators import mapping as M
from cloakspark.operators import trees
from cloakspark.operators.cycles import cycles
from cloakspark.operators.reports import rehydration_status, third_party_status
from cloakspark.operators.restoration import restored_json
from cloakspark.sources.session import checkpointed


def rehydrated(payloads: DataFrame, id_col: str, json_col: str, expected: DataFrame, read_mapping: Callable[[], DataFrame], max_passes: int = 5) -> tuple[dict[str, Any], DataFrame | None]:
    """A report, and id, JSON text, passes of the restored payloads; None in place of rows where restoration isn't run or fails.

    In order: tokens that came back more often than they went out fail it (`expected`: placeholder, n); a failed, dropped or
    skipped processing, or no returned token, ends it before the mapping is read; values that lead back to themselves
    fail it; a token that is left fails it, and no partial output is given.
    """
    payloads = checkpointed(payloads.select(id_col, json_col))
    returned = checkpointed(trees.token_counts(payloads, json_col))
    summary = M.integrity_summary(M.integrity(expected, returned)).first().asDict()
    if summary["unexpected_count"]:
        return {"status": "failed", "reason": "unexpected_placeholders", **summary}, None
    # the worst status of any payload counts
    worst = F.max(F.struct(F.when(F.col("s") == "failed", 3).when(F.col("s") == "file_drop", 2).when(F.col("s") == "skipped", 1).otherwise(0), "s"))["s"]
    said = payloads.select(third_party_status(F.col(json_col)).alias("s")).agg(F.coalesce(worst, F.lit("processed")).alias("s")).first()["s"]
    status = payloads.sparkSession.range(1).select(rehydration_status(F.lit(said), F.lit(summary["returned_count"])).alias("s")).first()["s"]
    report = {"third_party_status": said, "rehydration_status": status, "integrity": summary}
    if status != "completed":
        return {"status": status, **report}, payloads.withColumn("passes", F.lit(0)) if said == "processed" else None
    known = checkpointed(read_mapping())
    if n := cycles(known, returned.select("placeholder")).count():
        return {"status": "failed", "reason": "mapping_cycles", "tokens_on_cycles": n, **report}, None
    out = restored_json(payloads, id_col, json_col, known, max_passes)
    left = trees.token_counts(out, json_col).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if left:
        return {"status": "failed", "reason": "unresolved_placeholders", "unresolved": left, **report}, None
    return {"status": "completed", "unresolved": 0, "passes": out.agg(F.coalesce(F.max("passes"), F.lit(0)).alias("p")).first()["p"], **report}, out
