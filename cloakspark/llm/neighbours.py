"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are mapped so that the largest inner product is the smallest distance (scaled by the largest norm, with one
more coordinate), rotated at random to a few coordinates, shifted, and ordered along a Hilbert curve; several
rotations and shifts give several curves. Spark range-partitions the keys of each curve; counts by partition turn
them into ranks, ranks into blocks. A query meets the blocks with the WINDOW points on either side of its own rank on
every curve, however many points there are; the blocks' candidates are merged and reranked by the exact inner product.

Whether that is enough is measured, not assumed: CALIBRATION queries, drawn by hash, are also searched everywhere.
Among those whose last neighbour found is as near as some measure, the windows must have found RECALL of the true
neighbours; queries with nearer ones stop there (see `enough`). The others are searched on in the rest of the points, in
groups of GROUP consecutive ones of the first curve; a group is left out where its bounding box holds nothing nearer
than what a query has. So vectors that curves keep together cost a few windows, and vectors that no curve keeps
together (random directions in many dimensions) still get their neighbours. Equal vectors are one point with its
smallest ids, so that a vector which very many rows have fills no window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakspark.llm._common import checkpointed, prepared, table

NEAREST = 20
#: Rows whose id is divisible by this are queries.
EVERY = 20
CURVES, AXES, BITS = 4, 6, 10
#: Vectors that the grids of the axes are fitted on, and points on either side of a query that a window takes.
SAMPLE, WINDOW = 4096, 512
#: Queries that are searched everywhere to measure the windows, and the recall that they must show.
CALIBRATION, RECALL = 128, 0.97
#: Points of a block of a curve, and of a group of the rest; queries of a pack that meets a group.
BLOCK, GROUP, PACK = 512, 8192, 256
#: Packs that one task ranks against a group; a group is copied for more.
PACKS = 64
#: Bounding boxes of up to this many groups are sent to the packs (1 KB each); with more, all packs meet all groups.
BOXES = 20_000
SCHEMA = "query_id long, rank int, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of rows of coordinates in 0 .. 2**bits - 1."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Rotations and shifts of the curves, the largest norm, and the grid of each axis."""

    rotations: np.ndarray
    grids: np.ndarray
    shifts: np.ndarray
    norm: float

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Key of each row on each curve (rows, curves)."""
        return np.stack([hilbert(self._cells(x, query, c)) for c in range(len(self.rotations))], axis=1)

    def _cells(self, x: np.ndarray, query: bool, c: int) -> np.ndarray:
        y = _mapped(x, self.norm, query) @ self.rotations[c]
        grid = self.grids[c]
        share = np.stack([np.searchsorted(grid[a], y[:, a]) for a in range(y.shape[1])], axis=1) / len(grid[0])
        # shifted and scaled into the cube, so that no two curves have their folds at the same places
        return np.clip((share * 0.75 + self.shifts[c]) * (1 << BITS), 0, (1 << BITS) - 1)


def _mapped(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Points on the unit sphere of one more dimension: the nearest is that with the largest inner product."""
    if query:
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
    y = x / norm
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)


def fitted(sample: np.ndarray, norm: float, seed: int = 5) -> Curves:
    """Curves with random rotations and shifts, and grids at the quantiles of the sample."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    axes = min(AXES, width)
    rotations = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :axes] for _ in range(CURVES)])
    mapped = _mapped(sample, norm, False)
    grids = np.stack([np.quantile(mapped @ r, np.linspace(0, 1, 257)[1:-1], axis=0).T for r in rotations])
    return Curves(rotations, grids, rng.uniform(0, 0.25, (CURVES, 1, axes)), norm)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part.

    Left out are rows with a null id, and vectors null, empty, zero, or with a null or non-finite component. A vector
    shorter than the longest counts as zero in the components that it lacks.
    """
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) vector").where("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda v: v != 0))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    whole = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    return rows.select("vec_id", F.transform(F.when(F.size("vector") < width, whole).otherwise(F.col("vector")), lambda v: v + F.lit(0.0)).alias("vector"))


def points(rows: DataFrame) -> DataFrame:
    """vector, ids: each distinct vector with its NEAREST + 1 smallest ids, in order. rows: vec_id, vector."""
    # the limit by group is applied before the shuffle as well, so a vector of very many rows brings few
    few = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= NEAREST + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


_ROW = "curve int, key long, query boolean, point long, vector array<double>, ids array<long>"
_FOUND = "point long, score double, vec_id long"


def nearest(found: DataFrame) -> DataFrame:
    """point, score, vec_id: of each point the NEAREST + 1 best, each once; ties go to the smaller id. Limited before the shuffle as well."""
    order = Window.partitionBy("point").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= NEAREST + 1).drop("n").distinct()


def scored(q: np.ndarray, m: np.ndarray, ids: list[list[int]], bound: np.ndarray) -> Iterator[tuple[int, float, int]]:
    """Number of the query, exact score and id of the NEAREST + 1 best points of `m` for each query, of those that reach its bound."""
    scores = q @ m.T
    k = min(NEAREST + 1, len(m))
    least = np.maximum(np.partition(scores, len(m) - k, axis=1)[:, len(m) - k], bound)
    for i, (row, low) in enumerate(zip(scores, least - 1e-9 * np.abs(least) - 1e-12, strict=True)):
        near = np.flatnonzero(row >= low)
        exact = (m[near] * q[i]).sum(axis=1)
        best = sorted([(-s, v) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[j]])[: NEAREST + 1]
        yield from ((i, -s, v) for s, v in best)


def _answers(rows: list[tuple[int, float, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64()), strict=True)], ["point", "score", "vec_id"])


class Ordered:
    """Points and queries in the order of every curve, with the rank that each has among the points of its curve."""

    def __init__(self, data: DataFrame, queries: DataFrame):
        spark = data.sparkSession
        prepared(spark)
        self.n = data.count()
        sample = np.array([r["vector"] for r in data.select("vector", "point").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()], float)
        norm = data.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))).first()[0] * (1 + 1e-9)
        self.curves = curves = fitted(sample, norm)
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def keyed(query: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    keys = curves.keys(_matrix(b.column("vector")), query)
                    for c in range(keys.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys[:, c]), pa.array(np.full(len(keys), query)), *(b.column(x) for x in ("point", "vector", "ids"))], ["curve", "key", "query", "point", "vector", "ids"])

            return run

        both = data.select("point", "vector", "ids").mapInArrow(keyed(False), _ROW).unionByName(queries.select("point", "vector", "ids").mapInArrow(keyed(True), _ROW))
        self.rows = checkpointed(both.repartitionByRange(self.partitions, "curve", "key", "query", "point").sortWithinPartitions("curve", "key", "query", "point"))
        counts = {(r["p"], r["curve"]): r["count"] for r in self.rows.where("not query").groupBy(F.spark_partition_id().alias("p"), "curve").count().collect()}
        self.before, at = {}, [0] * CURVES
        for p in range(self.rows.rdd.getNumPartitions()):  # as many numbers as partitions and curves
            for c in range(CURVES):
                self.before[p, c] = at[c]
                at[c] += counts.get((p, c), 0)

    def ranked(self):
        """A function that gives the ranks of the rows of a batch; batches of a partition come in order."""
        before = self.before

        def start():
            own = {c: before.get((TaskContext.get().partitionId(), c), 0) for c in range(CURVES)}

            def ranks(b: pa.RecordBatch) -> np.ndarray:
                curve, query = np.asarray(b.column("curve")), np.asarray(b.column("query"))
                rank = np.zeros(len(curve), np.int64)
                for c in np.unique(curve).tolist():
                    m = curve == c
                    passed = np.cumsum(~query[m])
                    rank[m] = own[c] + passed - ~query[m]
                    own[c] += int(passed[-1])
                return rank

            return ranks

        return start


def in_windows(order: Ordered) -> DataFrame:
    """point, score, vec_id: the best that each query finds in the blocks around its rank, on all curves."""
    start, last = order.ranked(), (order.n - 1) // BLOCK

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = start()
        for b in batches:
            query, rank = np.asarray(b.column("query")), ranks(b)
            low = np.where(query, np.maximum(rank - WINDOW, 0), rank) // BLOCK
            high = np.minimum(np.where(query, rank + WINDOW, rank) // BLOCK, last)
            times = np.maximum(high - low + 1, 1)
            take = np.repeat(np.arange(len(rank)), times)
            block = np.repeat(np.minimum(low, last), times) + np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(take), 4096):
                t = pa.array(take[a : a + 4096])
                yield pa.RecordBatch.from_arrays([b.column("curve").take(t), pa.array(block[a : a + 4096]), *(b.column(x).take(t) for x in ("query", "point", "vector", "ids"))], ["curve", "block", "query", "point", "vector", "ids"])

    met = order.rows.mapInArrow(blocked, "curve int, block long, query boolean, point long, vector array<double>, ids array<long>").repartition(order.partitions, "curve", "block").sortWithinPartitions("curve", "block", "query")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, x, ids = None, [], []
        for b in batches:  # a block's points come before its queries
            if not b.num_rows:
                continue
            curve, block, query = (np.asarray(b.column(c)) for c in ("curve", "block", "query"))
            cut = [0, *(np.flatnonzero((curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), len(curve)]
            for a, z in zip(cut, cut[1:], strict=False):
                part = b.slice(a, z - a)
                if here != (key := (int(curve[a]), int(block[a]))):
                    here, x, ids = key, [], []
                if not query[a]:
                    x.append(_matrix(part.column("vector")))
                    ids += part.column("ids").to_pylist()
                elif x:
                    names = part.column("point").to_pylist()
                    yield _answers([(names[i], s, v) for i, s, v in scored(_matrix(part.column("vector")), np.concatenate(x), ids, np.full(len(part), -np.inf))])

    return nearest(met.mapInArrow(answered, _FOUND))


def bounds(found: DataFrame) -> DataFrame:
    """point, bound: the score that a neighbour must reach to be among the NEAREST + 1 best found; minus infinity for fewer."""
    return found.groupBy("point").agg(F.when(F.count("*") > NEAREST, F.min("score")).otherwise(float("-inf")).alias("bound"))


def in_the_rest(order: Ordered, asked: DataFrame) -> DataFrame:
    """point, score, vec_id: all that reach a query's bound, at most NEAREST + 1 of each group of points. asked: point, vector, key, bound."""
    start, groups = order.ranked(), (order.n - 1) // GROUP + 1
    points_ = order.rows.where("curve = 0")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = start()
        for b in batches:
            group, query = ranks(b) // GROUP, np.asarray(b.column("query"))
            for g in np.unique(group[~query]).tolist():
                m = _matrix(b.column("vector").filter(pa.array((group == g) & ~query)))
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([m.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([m.max(axis=0).tolist()], pa.list_(pa.float64()))], ["group", "low", "high"])

    box = None
    if groups <= BOXES:
        rows = points_.mapInArrow(boxes, "group long, low array<double>, high array<double>").select("group", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x")).groupBy("group", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        got = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("x")).orderBy("group").collect()
        box = np.array([[(x["low"], x["high"]) for x in r["x"]] for r in got])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for b in batches:
            for a in range(0, b.num_rows, PACK):
                part = b.slice(a, PACK)
                q, bound = _matrix(part.column("vector")), np.asarray(part.column("bound"))
                meets = np.arange(groups)
                if box is not None:  # the largest inner product that a box can hold, for each query
                    most = np.maximum(q, 0) @ box[:, :, 1].T + np.minimum(q, 0) @ box[:, :, 0].T
                    meets = np.flatnonzero((most + 1e-9 >= bound[:, None]).any(axis=0))
                number += 1
                row = [pa.array([np.asarray(part.column("point")).tobytes()] * len(meets), pa.binary()), pa.array([q.tobytes()] * len(meets), pa.binary()), pa.array([bound.tobytes()] * len(meets), pa.binary())]
                none = pa.nulls(len(meets), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(meets), pa.array(np.full(len(meets), number)), none, pa.nulls(len(meets), pa.list_(pa.float64())), pa.nulls(len(meets), pa.list_(pa.int64())), *row], ["group", "pack", "point", "vector", "ids", "points", "queries", "bounds"])

    schema = "group long, pack long, point long, vector array<double>, ids array<long>, points binary, queries binary, bounds binary"
    packs = asked.repartitionByRange(order.partitions, "key", "point").sortWithinPartitions("key", "point").select("point", "vector", "bound").mapInArrow(packed, schema)
    strips = max(1, -(-asked.count() // (PACK * PACKS)))  # copies of a group, so that no task ranks more than so many packs

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = start()
        for b in batches:
            group, own = ranks(b) // GROUP, pa.array(~np.asarray(b.column("query")))
            n = int(np.asarray(own).sum())
            nothing = [pa.nulls(n, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(group).filter(own), pa.nulls(n, pa.int64()), *(b.column(x).filter(own) for x in ("point", "vector", "ids")), *nothing], ["group", "pack", "point", "vector", "ids", "points", "queries", "bounds"])

    data = points_.mapInArrow(grouped, schema).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    packs = packs.withColumn("strip", F.pmod(F.xxhash64("pack"), F.lit(strips)).cast("int"))
    met = data.unionByName(packs).repartition(order.partitions, "group", "strip").sortWithinPartitions("group", "strip", F.col("pack").asc_nulls_first())

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, x, ids = None, [], []
        for b in batches:  # a group's points come before the packs
            for i, (group, strip, pack) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "strip", "pack")), strict=True)):
                if here != (group, strip):
                    here, x, ids = (group, strip), [], []
                if pack is None:
                    x.append(np.asarray(b.column("vector")[i].values, np.float64))
                    ids.append(b.column("ids")[i].as_py())
                elif ids:
                    if isinstance(x, list):
                        x = np.stack(x)
                    names, bound = (np.frombuffer(b.column(c)[i].as_py(), k) for c, k in (("points", np.int64), ("bounds", np.float64)))
                    q = np.frombuffer(b.column("queries")[i].as_py(), np.float64).reshape(len(names), -1)
                    yield _answers([(int(names[k]), s, v) for k, s, v in scored(q, x, ids, bound)])

    return met.mapInArrow(answered, _FOUND)


def enough(windows: DataFrame, true: DataFrame, cosines: DataFrame) -> float:
    """The cosine from which queries need no further search: those whose last neighbour found is as near had RECALL of their true neighbours found.

    Both frames hold the same CALIBRATION queries at most. cosines: point, cosine (of the last neighbour found in the windows).
    """
    hits = true.select("point", "vec_id").join(windows.select("point", "vec_id", F.lit(1).alias("hit")), ["point", "vec_id"], "left").groupBy("point").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    best, total = float("inf"), 0.0
    for k, r in enumerate(hits.join(cosines, "point").orderBy(F.desc("cosine")).collect(), 1):
        total += r["recall"]
        if total / k >= RECALL:
            best = r["cosine"]
    return best


def searched(vectors: DataFrame, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST nearest rows found for every row whose id is divisible by EVERY.

    Rows that `usable` leaves out are neither queries nor candidates. Ties go to the smaller vec_id; repeated rows (equal id
    and vector) count once, rows with equal ids and different vectors are searched each, and the best answers kept.
    Queries with no other usable vector give no rows. Columns other than vec_id and embedding aren't read. `report` is
    given the measure of `enough` and how many queries were searched on.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    hashed = F.xxhash64("vector").alias("point")
    data = checkpointed(points(rows).withColumn("point", hashed))
    if data.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    # every id of a queried vector is needed, so queries are read from the rows again
    asked = checkpointed(rows.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), hashed).distinct())
    queries = data.join(asked.select("point").distinct(), "point", "left_semi")
    order = Ordered(data, queries)
    found = checkpointed(in_windows(order))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    # how near the last one found is, as the cosine in the mapped space: all points there have the largest norm
    every = checkpointed(order.rows.where("query and curve = 0").join(bounds(found), "point").select("point", "vector", "key", "bound", (F.col("bound") / (norm * order.curves.norm)).alias("cosine")))
    few = checkpointed(every.orderBy(F.xxhash64("point", F.lit(1)), "point").limit(CALIBRATION))
    true = checkpointed(nearest(found.join(few, "point", "left_semi").unionByName(in_the_rest(order, few))))
    limit = enough(found.join(few, "point", "left_semi"), true, few.select("point", "cosine"))
    left = every.where(F.col("cosine") < limit).join(few.select("point"), "point", "left_anti")
    n = left.count()
    if report is not None:
        report |= {"enough": limit, "searched_on": n, "queries": every.count()}
    found = found.join(few.select("point"), "point", "left_anti").unionByName(true)
    if n:
        found = nearest(found.unionByName(in_the_rest(order, checkpointed(left))))
    answers = asked.join(found, "point").where("vec_id <> query_id").select("query_id", "score", "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every 20th row of the embeddings."""
    return searched(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLES: dict[str, str] = {}
