"""Masking of a stream: the column functions hold no state, so they run under readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cloakspark.operators.mapping import first_seen, found_in
from cloakspark.operators.masking import masked_in_steps
from cloakspark.sources.handoff import write_stage


def masked_files(spark: SparkSession, path: str, schema: StructType, text_col: str, run_id: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the text masked."""
    return masked_in_steps(spark.readStream.schema(schema).parquet(path), text_col, run_id)


def mask_available(spark: SparkSession, path: str, schema: StructType, id_col: str, text_col: str, run_id: str, out: str, store: str, checkpoint: str) -> StreamingQuery:
    """Mask all files that are there, and write each batch's mapping to its own partition, so that a batch done again replaces it."""

    def each(batch: DataFrame, epoch: int) -> None:
        write_stage(masked_in_steps(batch, text_col, run_id), out, "stream", run_id, f"batch-{epoch}")
        write_stage(first_seen(found_in(batch, id_col, text_col, run_id)), store, "stream", run_id, f"batch-{epoch}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
