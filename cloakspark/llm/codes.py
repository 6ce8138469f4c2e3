"""Vector code compression: product quantisation in whole numbers, with partial-distance search.

Vectors are cut into equal parts, and each part is replaced by the index of the nearest entry of its codebook.
Codebooks are fitted on all rows by rounds of assignment and averaging: a round sums parts by entry within each
task, then over tasks, and the driver gets only the sums of all entries.

The nearest entry is searched one dimension at a time, those in which the codebook varies most first. A pair of
row and entry is dropped as soon as its distance so far strictly exceeds the best complete distance of the row,
so equal distances live on and the lower index can win.

All arithmetic is exact. Components are 64-bit integers while their squares can't overflow, and Python's own
integers beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm._common import checkpointed, prepared, shared_folder, table
from cloakspark.llm.simhash import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this are summed and squared as 64-bit integers.
SMALL = 1 << 24
#: Rows that a task takes at once.
ROWS = 4096
#: Sums of an entry's components travel as decimals of so many digits.
SUM = "decimal(38,0)"
SCHEMA = "vec_id long, label string, code string, error decimal(38,0)"


def variance_order(book: np.ndarray) -> np.ndarray:
    """The dimensions of a codebook, the one in which its entries vary most first."""
    far = book.astype(np.float64)
    return np.argsort(-far.var(axis=0), kind="stable")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for every row of x, ties to the lower index."""
    rows, width = x.shape
    if not width:
        return np.zeros(rows, np.int64), np.zeros(rows, x.dtype)
    order = variance_order(book)
    lead = x[:, order[0], None] - book[None, :, order[0]]
    lead = lead * lead  # of all pairs, the first dimension
    # the entry nearest in that dimension gives the first complete distance
    index = np.argmin(lead, axis=1)
    gap = x - book[index]
    best = (gap * gap).sum(axis=1)
    row, entry = np.nonzero(lead <= best[:, None])
    so_far = lead[row, entry]
    for d in order[1:]:
        gap = x[row, d] - book[entry, d]
        so_far = so_far + gap * gap
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    # what is left is complete and no farther than the first one; later entries go on only if they are strictly nearer
    for e in range(len(book)):
        own = entry == e
        r, v = row[own], so_far[own]
        better = (v < best[r]) | ((v == best[r]) & (e < index[r]))
        index[r[better]], best[r[better]] = e, v[better]
    return index, best


def integers(column: pa.Array, width: int) -> np.ndarray:
    """rows x width of floor(SCALE * component), zeros beyond a vector's end. Python integers where any is large."""
    offsets = np.diff(column.offsets.to_numpy())
    flat = np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
    full = len(offsets) * width == len(flat) and bool((offsets == width).all())
    if full:
        x = flat.reshape(-1, width)
    else:
        x = np.zeros((len(offsets), width))
        x[np.arange(width) < offsets[:, None]] = flat
    if not len(flat) or np.abs(flat).max() <= SMALL:
        return x.astype(np.int64)
    whole = np.empty(x.shape, object)
    whole[...] = [[int(v) for v in row] for row in x]
    return whole


class Books:
    """The codebooks of all parts: PARTS arrays of entries x (width / PARTS)."""

    def __init__(self, books: list[list[list[int]]]):
        most = max((abs(v) for b in books for e in b for v in e), default=0)
        self.large = most > SMALL
        self.books = [np.array(b, object if self.large else np.int64).reshape(len(b), -1) for b in books]
        self.step = self.books[0].shape[1]
        self.width = self.step * len(books)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x parts of indexes, and of squared distances."""
        found = [nearest(x[:, p * self.step : (p + 1) * self.step], b) for p, b in enumerate(self.books)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def plain(self) -> list[list[list[int]]]:
        return [[[int(v) for v in e] for e in b] for b in self.books]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.plain() for e in b for v in e).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """vec_id, label, vector (array<double>) of the rows that are coded: vector not null, all its components finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    label: Column = F.lit(None) if label_col is None else F.col(label_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)))


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[list[list[list[int]]], int]:
    """The codebooks to start from, and the width: the parts of the `entries` smallest ids (of rows with one id, the smallest vector)."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // parts) * parts
    ids: list[int] = []
    while len(ids) < entries:  # one round where ids don't repeat
        rest = rows.where(F.col("vec_id") > ids[-1]) if ids else rows.where(F.col("vec_id").isNotNull())
        if not (more := rest.select("vec_id").orderBy("vec_id").limit(entries - len(ids)).collect()):
            break
        ids += sorted({r["vec_id"] for r in more})
    few = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    if len(ids) < entries:  # rows without an id come last, as one
        few += rows.where(F.col("vec_id").isNull()).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()
    step = width // parts
    whole = [[int(np.floor(v * SCALE)) for v in r["vector"]] for r in few]
    whole = [v + [0] * (width - len(v)) for v in whole]
    return [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)], width


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ROWS."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def entry_sums(rows: DataFrame, books: Books) -> DataFrame:
    """part, entry, at, total, n: sums of components by entry and position, over all rows."""
    schema = f"part int, entry int, at int, total {SUM}, n long"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books.books]
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        for block in _blocks(batches):
            x = integers(block.column("vector"), books.width)
            index, _ = books.coded(x)
            for p in range(len(books.books)):
                part = x[:, p * books.step : (p + 1) * books.step]
                counts[p] += np.bincount(index[:, p], minlength=len(counts[p]))
                own = np.zeros(totals[p].shape, x.dtype)
                np.add.at(own, index[:, p], part)
                totals[p] = totals[p] + own
        out = [(p, e, k, int(totals[p][e, k]), int(counts[p][e])) for p in range(len(counts)) for e in np.nonzero(counts[p])[0] for k in range(books.step)]
        if out:
            part, entry, at, total, n = zip(*out, strict=True)
            numbers = [pa.array(map(int, c), pa.int32()) for c in (part, entry, at)]
            yield pa.RecordBatch.from_arrays([*numbers, _decimals(total), pa.array(n, pa.int64())], ["part", "entry", "at", "total", "n"])

    prepared(rows.sparkSession)
    return rows.select("vector").mapInArrow(summed, schema).groupBy("part", "entry", "at").agg(F.sum("total").cast(SUM).alias("total"), F.sum("n").alias("n"))


def _decimals(values) -> pa.Array:
    """Whole numbers as decimals of 38 digits; an error beyond those."""
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books | None:
    """Codebooks after `rounds` rounds over all rows of `usable`; None for no rows. The driver gets parts x entries sums a round."""
    first, _ = first_books(rows, parts, entries)
    if not first[0]:
        return None
    books = Books(first)
    for _ in range(rounds):
        new = books.plain()
        for r in entry_sums(rows, books).collect():
            new[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]  # floor, also below zero
        books = Books(new)
    return books


def assigned(rows: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error of all rows of `usable`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            index, distance = books.coded(integers(block.column("vector"), books.width))
            codes = ["".join([f"{i:02x}" for i in row]) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), pa.array(codes), _decimals(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])

    prepared(rows.sparkSession)
    return rows.mapInArrow(each, SCHEMA)


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that `usable` keeps.

    Rows with a null vector, or with null or non-finite components, are left out; an empty table gives no rows. Rows
    with null ids are coded and take part in the averages, and start a codebook only where there are fewer ids than
    entries. Of repeated ids the smallest vector counts for the start; all their rows are coded. Fewer rows than
    entries give fewer entries. Vectors shorter than the longest, or whose length the parts don't divide, count as
    zero beyond their end. Equal distances go to the lower index. Null labels sum together. Other columns aren't read.
    Sums beyond 38 digits (components of about 10^15 and more) are an error; an error beyond a long is null.
    """
    spark = vectors.sparkSession
    shared_folder(spark)
    rows = usable(vectors, id_col, vector_col, label_col)
    books = fitted(rows)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # labels may be very few or as many as rows: their sums come from partial ones, and a label of very many rows is spread
    done = checkpointed(assigned(rows, books).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))))
    sums = done.groupBy("key").agg(F.sum("error").alias("label_error"))
    whole = lambda c: F.when((F.col(c) <= 2**63 - 1) & (F.col(c) >= -(2**63)), F.col(c).cast("long")).alias(c)
    return spread_join(done, sums, "key").select("vec_id", "code", whole("error"), whole("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, error of the label and digest of the codebooks for every usable row of the embeddings."""
    return coded(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds, written out one after the other: distances to every entry, the nearest, and its new average."""
    steps = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS k, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        f"b0 AS MATERIALIZED (SELECT part, e, k, x FROM cells JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (r))",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT r, part, e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN b{n} b USING (part, k) GROUP BY ALL)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, part, e, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, e) = 1)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT part, e, k, sum(x) AS s, count(*) AS n FROM cells JOIN a{n} USING (r, part) GROUP BY ALL)")
            floor = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, e, k, CASE WHEN n IS NULL THEN x ELSE {floor} END AS x FROM b{n} LEFT JOIN m{n} USING (part, e, k))")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, k)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


QUERIES = {"op11_codes": op11_codes}
ORACLES = {"op11_codes": _sql()}
