"""Values of a batch replaced in all texts of the batch, in one pass over each, with the values that replaced something.

A batch travels as one row: its rows, and its values in order of their turn. A task builds one automaton per batch and
cuts every text at the matches; tokens and the new texts are made by column functions. A batch is bounded by its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cloakspark.functions.finder import Finder
from cloakspark.sources.session import with_package

#: Pieces of texts that a task gathers before it hands them on.
PIECES_AT_ONCE = 20_000
_PIECES = K.ArrayType(K.StructType([K.StructField("gap", K.StringType()), K.StructField("hit", K.StringType()), K.StructField("k", K.IntegerType())]))


class _Cuts:
    """What texts were cut into, column by column: of batches their rows, of rows their texts, of texts their pieces."""

    def __init__(self):
        self.gaps: list[str] = []
        self.hits: list[str | None] = []
        self.numbers: list[int | None] = []
        self.ends: list[list[int | None]] = [[0], [0], [0]]

    def add(self, finder: Finder | None, rows: list[tuple[str | None, ...]]) -> None:
        """Of one batch."""
        batches, texts, pieces = self.ends
        for row in rows:
            for text in row:
                cut = finder and finder.pieces(text)
                if cut is None:
                    pieces[-1] = None  # a null begins where it ends
                else:
                    for gap, hit, k in cut:
                        self.gaps.append(gap)
                        self.hits.append(hit)
                        self.numbers.append(k)
                pieces.append(len(self.gaps))
            texts.append(len(pieces) - 1)
        batches.append(len(texts) - 1)

    def array(self) -> pa.Array:
        out = pa.StructArray.from_arrays([pa.array(self.gaps, pa.string()), pa.array(self.hits, pa.string()), pa.array(self.numbers, pa.int32())], ["gap", "hit", "k"])
        for ends in reversed(self.ends):
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out)
        return out


def replaced(rows: DataFrame, values: DataFrame, batch: str, columns: list[str], each: Callable[[Column, Column], Column], applied: str | None = None, tasks: int | None = None) -> DataFrame:
    """`rows` with every occurrence of the values of their batch replaced in `columns` by each(value, match); see `finder` for the rules.

    values: batch, found (an array of structs with a field `value`, in order of turn). `applied`, if given, names a further
    column: the structs that replaced something in the row, each once, in order. Rows whose batch has no values, and rows
    without a batch, stay as they are; null texts stay null. `tasks`, if given, deals the batches out over that many tasks.
    """
    with_package(rows.sparkSession)
    names = rows.columns
    found = values.select(F.col(batch).alias("__batch"), "found")
    dealt = rows.repartition(tasks, batch) if tasks else rows
    whole = dealt.groupBy(F.col(batch).alias("__batch")).agg(F.collect_list(F.struct(*names)).alias("rows")).join(found, "__batch", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, at = _Cuts(), 0
            for i, (r, f) in enumerate(zip(b.column("rows"), b.column("found"), strict=True)):
                finder = Finder([v["value"] or "" for v in f.as_py()]) if f.is_valid else None
                made.add(finder, list(zip(*(r.values.field(c).to_pylist() for c in columns), strict=True)))
                if len(made.gaps) >= PIECES_AT_ONCE or i + 1 == b.num_rows:
                    part = b.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([part.column("rows"), part.column("found"), made.array()], ["rows", "found", "cuts"])
                    made, at = _Cuts(), i + 1

    schema = K.StructType([*whole.select("rows", "found").schema.fields, K.StructField("cuts", K.ArrayType(K.ArrayType(_PIECES)))])
    done = whole.select("rows", "found").mapInArrow(cut, schema)
    one = done.select("found", F.explode(F.arrays_zip("rows", "cuts")).alias("r")).select("found", "r.rows", F.col("r.cuts").alias("__cuts"))
    value = lambda p: F.get(F.col("found"), p["k"])
    new = {}
    for i, c in enumerate(columns):
        pieces = F.col("__cuts")[i]
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.when(p["k"].isNull(), "").otherwise(each(value(p), p["hit"])))), "")
        new[c] = F.when(pieces.isNull(), F.col(f"rows.`{c}`")).otherwise(text)
    did = []
    if applied:
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("__cuts", lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast(_PIECES)), lambda p: p["k"].isNotNull()), lambda p: p["k"])))))
        did = [F.transform(numbers, lambda k: F.get(F.col("found"), k)).alias(applied)]
    return one.select(*[new[c].alias(c) if c in new else F.col(f"rows.`{c}`").alias(c) for c in names], *did)
