"""Dense row numbers, and batches packed in order, without a global window and without a task per group.

Both rest on a frame that is kept (checkpointed), so that its partitions and the order in them stay: a task needs only
what the tasks before it sum up to, a few numbers per partition that the driver adds up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.pandas.types import to_arrow_schema

from cloakspark.operators.records import MAX_CHARACTERS
from cloakspark.sources.session import checkpointed, with_package


def numbered(df: DataFrame, column: str = "row", first: int = 0) -> DataFrame:
    """`df` with a dense number from `first` on, repeated rows and nulls included.

    A frame read from files is numbered in order of their paths, and in order of the lines in each; any other in order of
    its partitions. Parts are counted where they are; the driver adds up one count per part (a file's block or a partition).
    """
    try:
        kept = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    except AnalysisException:
        kept = df.select("*", F.lit("").alias("__file"), F.lit(0).cast("long").alias("__start"))
    # within a partition the id counts up by one
    kept = checkpointed(kept.withColumn("__id", F.monotonically_increasing_id()))
    part = [F.col("__file"), F.col("__start"), F.shiftright("__id", 33).alias("__part")]
    sizes = sorted(tuple(r) for r in kept.groupBy(*part).agg(F.min("__id"), F.count("*")).collect())
    rows, at = [], first
    for *_, p, least, n in sizes:
        rows.append((p, least, least + n, at - least))
        at += n
    shift = kept.sparkSession.createDataFrame(rows, "__p long, __from long, __to long, __shift long")  # a row per part
    whole = kept.join(F.broadcast(shift), (F.shiftright("__id", 33) == F.col("__p")) & (F.col("__id") >= F.col("__from")) & (F.col("__id") < F.col("__to")))
    return whole.select(*[f"`{c}`" for c in df.columns], (F.col("__id") + F.col("__shift")).alias(column))


def _next_starts(sizes: np.ndarray, most: int, characters: int) -> np.ndarray:
    """For each row the row where the next batch starts if one starts here: full, or too long with the next row."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    # the first row that doesn't fit any more, found in the prefix sums
    beyond = np.searchsorted(sums, sums[:-1] + characters, side="right") - 1
    return np.minimum(np.minimum(np.maximum(beyond, np.arange(len(sizes)) + 1), np.arange(len(sizes)) + most), len(sizes))


class _Part:
    """One partition: rows in order, in runs of equal groups. Keys are compared as they come from Arrow."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        held = list(batches)
        self.rows = pa.Table.from_batches(held) if held else None
        self.n = self.rows.num_rows if held else 0
        if not self.n:
            return
        self.sizes = self.rows.column("s").to_numpy().astype(np.int64)
        keys = self.rows.column("g").combine_chunks().dictionary_encode()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.runs = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [self.n]])
        self.lead = int(self.runs[1])
        self.first, self.last = self.rows.column("g")[0].as_py(), self.rows.column("g")[self.n - 1].as_py()


#: Rows of a partition that a task packs at once, and their sizes together where they carry further columns.
ROWS_A_PART = 200_000
SIZE_A_PART = 50_000_000


def greedy_batches(df: DataFrame, group: str, order: str, size: str, max_records: int, max_characters: int = MAX_CHARACTERS, also: Sequence[str] = ()) -> DataFrame:
    """group, order, batch, and the columns `also`: in each group records are packed in order; a batch closes when it is full or would grow too long.

    Rows are sorted over all tasks by group and order, so a group of any size is spread. Where a batch would start tells
    where the next one does, by a search in prefix sums; what a task has to know of the others is how many of its first
    rows belong to a batch that is open, and that is a table of max_records entries per partition, which the driver
    follows from partition to partition. A null size counts as 0, and null groups are one group; rows equal in group and
    order come in order of size. A single record may be longer than max_characters. A task holds its partition, so there
    are as many partitions as `ROWS_A_PART` makes of the rows (with columns `also`, `SIZE_A_PART` of the sizes), or one for each core.
    """
    with_package(df.sparkSession)
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"), *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(also)])
    # equal rows are told apart, so that they are dealt over tasks as well
    key, (n_rows, whole_size) = ["g", "o", "s", "t"], rows.agg(F.count("*"), F.sum("s")).first() if also else (df.count(), 0)
    parts_ = max(1, -(-n_rows // ROWS_A_PART), -(-(whole_size or 0) // SIZE_A_PART), min(n_rows, df.sparkSession.sparkContext.defaultParallelism))
    rows = checkpointed(rows.withColumn("t", F.monotonically_increasing_id()).repartitionByRange(parts_, *key).sortWithinPartitions(*key).drop("t"))
    most, kinds, sizes_only = max(1, max_records), {f.name: f.dataType for f in rows.schema}, rows.select("g", "o", "s")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Part(batches)
        if p.n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "n": p.n, "lead": p.lead, "whole": len(p.runs) == 2, "first": p.first, "last": p.last, "sizes": p.sizes[: min(most, p.lead)].tolist()}], schema=None)

    head_kind = K.StructType([K.StructField("part", K.LongType()), K.StructField("n", K.LongType()), K.StructField("lead", K.LongType()), K.StructField("whole", K.BooleanType()), K.StructField("first", kinds["g"]), K.StructField("last", kinds["g"]), K.StructField("sizes", K.ArrayType(K.LongType()))])
    parts = sorted((r.asDict() for r in sizes_only.mapInArrow(_typed(heads, head_kind), head_kind).collect()), key=lambda r: r["part"])
    for here, then in zip(parts, [*parts[1:], None][: len(parts)], strict=True):
        here["goes_on"] = then is not None and then["first"] == here["last"]
    ahead: dict[int, list[int]] = {}
    for k, here in enumerate(parts):
        more: list[int] = []
        for j in range(k, len(parts) - 1):  # past short partitions that are one group
            if not parts[j]["goes_on"] or len(more) >= most:
                break
            more += parts[j + 1]["sizes"]
            if not parts[j + 1]["whole"]:
                break
        ahead[here["part"]] = more[:most]

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Part(batches)
        if p.n:
            part, a = TaskContext.get().partitionId(), int(p.runs[-2])
            sizes = np.concatenate([p.sizes[a:], np.array(ahead[part], np.int64)])
            after, n = _next_starts(sizes, most, max_characters).tolist(), p.n - a
            leaves, starts = [0] * n, [0] * n
            for i in range(n - 1, -1, -1):
                leaves[i], starts[i] = (after[i] - n, 1) if after[i] >= n else (leaves[after[i]], starts[after[i]] + 1)
            whole = len(p.runs) == 2
            # by rows at the start that belong to an open batch: rows of the next partition that do, and batches begun in the last group
            table = [(o - n, 0) if o >= n else (leaves[o], starts[o]) for o in range(most + 1)] if whole else [(leaves[0], starts[0])]
            yield pa.RecordBatch.from_pylist([{"part": part, "leaves": [x for x, _ in table], "starts": [x for _, x in table]}])

    exit_kind = K.StructType([K.StructField("part", K.LongType()), K.StructField("leaves", K.ArrayType(K.LongType())), K.StructField("starts", K.ArrayType(K.LongType()))])
    tables = {r["part"]: r for r in sizes_only.mapInArrow(_typed(exits, exit_kind), exit_kind).collect()}
    entry: dict[int, tuple[int, int]] = {}
    open_, begun, before = 0, 0, None
    for here in parts:
        if before is None or not before["goes_on"]:
            open_ = begun = 0
        entry[here["part"]] = (open_, begun)
        t = tables[here["part"]]
        k = open_ if here["whole"] else 0
        open_, begun = t["leaves"][k], t["starts"][k] + (begun if here["whole"] else 0)
        before = here

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Part(batches)
        if not p.n:
            return
        part = TaskContext.get().partitionId()
        open_, begun = entry[part]
        out = np.zeros(p.n, np.int64)
        for k, (a, b) in enumerate(zip(p.runs[:-1].tolist(), p.runs[1:].tolist(), strict=True)):
            skip, number = (min(open_, b - a), begun) if k == 0 else (0, 0)
            ahead_ = np.array(ahead[part] if b == p.n else [], np.int64)
            after = _next_starts(np.concatenate([p.sizes[a:b], ahead_]), most, max_characters).tolist()
            out[a : a + skip] = number - 1
            i = skip
            while i < b - a:
                out[a + i : a + min(after[i], b - a)] = number
                i, number = after[i], number + 1
        t = p.rows.drop_columns(["s"]).append_column("batch", pa.array(out, pa.int32()))
        yield from t.to_batches()

    done = K.StructType([K.StructField("g", kinds["g"]), K.StructField("o", kinds["o"]), *[K.StructField(f"a{i}", kinds[f"a{i}"]) for i in range(len(also))], K.StructField("batch", K.IntegerType())])
    return rows.mapInArrow(walk, done).select(F.col("g").alias(group), F.col("o").alias(order), "batch", *[F.col(f"a{i}").alias(c) for i, c in enumerate(also)])


def _typed(make, kind: K.StructType):
    """The function of batches with its columns in the types of a schema."""
    arrow: Any = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in make(batches):
            yield pa.RecordBatch.from_pylist(b.to_pylist(), schema=arrow)

    return run
