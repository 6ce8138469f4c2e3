"""SimHash near-duplicates by the generalised pigeonhole principle.

Every document gets a 64-bit fingerprint of its three-word shingles. Two fingerprints with at most DISTANCE
differing bits are linked. The bits are grouped into m partitions, correlated bits together; if the thresholds of
the partitions add up to DISTANCE - m + 1, linked fingerprints are within its threshold in some partition (a
threshold of -1 leaves a partition out). Dynamic programming picks thresholds with the least estimated cost over
candidate counts, for each m, and the cheapest m is taken. A fingerprint is sent to the bucket of its own value in
each partition, and to the values within the threshold; in a bucket, distances over all 64 bits verify links.

Equal fingerprints are one node. A bucket yields a spanning forest of its links, not its pairs; buckets with more
than BUCKET nodes are split into chunks that meet pairwise. Components then come from alternating large-star and
small-star steps over the forest edges, which stay in Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakspark.llm._common import checkpointed, map_batches, prepared, table, texts_of

WORDS = 3
DISTANCE = 3
SEED = 42
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (2, 3, 4, 5)
#: Nodes of a bucket that one task compares; larger buckets are split into chunks of half of it, compared two by two.
BUCKET = 16_384
#: Rows of one key that a join may bring to one task; a key of more is spread over several.
JOIN_ROWS = 200_000
#: Buckets up to this size are compared at once, larger ones by search from node to node.
AT_ONCE = 128
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DISTANCE = np.uint8(DISTANCE)


def shingle_hashes(text: str) -> bytes:
    """XXH64 (seed 42) of every shingle of a whole text, 8 big-endian bytes each, repeats included."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), (ends[WORDS - 1 :] - 1).tolist(), strict=True)])


def fingerprint(text: str) -> int:
    """64 bits, each 1 if set in over half of the shingle hashes; 0 for a text without words."""
    raw = shingle_hashes(text)
    if not raw:
        return 0
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    n = len(bits) // 64
    eights = bits.view(np.uint64).reshape(n, 8)  # eight counters of a byte each
    counts = np.add.reduceat(eights, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has no words, null ids pass through."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

        return each

    return map_batches(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text"), make, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and for every two bits in how many nodes both are set; from all nodes, 4096 sums."""
    prepared(nodes.sparkSession)

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(np.asarray(b.column("fp")).astype(">i8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().astype(np.int64)], pa.list_(pa.int64()))], ["both"])

    sums = nodes.select("fp").mapInArrow(run, "both array<long>").select(F.posexplode("both").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    both = np.zeros(4096)
    for r in sums.collect():
        both[r["at"]] = r["n"]
    return nodes.count(), both.reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 the highest) in `parts` groups of nearly equal size, correlated ones together: each group grows from the most correlated pair left."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        sub = corr[np.ix_(rest, rest)]
        first = int(sub.argmax()) // len(rest)
        group = [rest[first]]
        while len(group) < size:
            others = [b for b in rest if b not in group]
            group.append(max(others, key=lambda b: (corr[b, group].sum(), -b)))  # noqa: B023
        left -= set(group)
        out.append(sorted(group))
    return out


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of a group of bits of each fingerprint."""
    out = np.zeros(len(fps), np.uint64)
    for b in bits:
        out = out << np.uint64(1) | (fps >> np.uint64(63 - b) & np.uint64(1))
    return out


def within(p: np.ndarray, distance: int) -> np.ndarray:
    """Probability that two nodes differ in at most 0, 1, .. distance of bits that are set with probabilities p."""
    dist = np.zeros(distance + 1)
    dist[0] = 1.0
    for q in 2 * p * (1 - p):
        dist = dist * (1 - q) + np.concatenate([[0], dist[:-1]]) * q
    return np.cumsum(dist)


def balls(width: int, radius: int) -> int:
    """Values within a radius of a value of so many bits."""
    return sum([int(np.prod(range(width - k + 1, width + 1)) // np.prod(range(1, k + 1))) if k else 1 for k in range(radius + 1)])


def allocated(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that add up to `total` at the least cost, by dynamic programming. costs[i][t + 1]: partition i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                new = (v + c[t + 1], [*chosen, t])
                if s + t not in step or new < step[s + t]:
                    step[s + t] = new
        best = step
    return best[total]


def plan(nodes: DataFrame) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition that is probed, from counts over all nodes."""
    n, both = bit_counts(nodes)
    groups = {m: grouped_bits(n, both, m) for m in PARTITIONS}
    flat = [(m, k, bits) for m, gs in groups.items() for k, bits in enumerate(gs)]
    prepared(nodes.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.asarray(b.column("fp")).view(np.uint64)
            part = np.repeat(np.arange(len(flat), dtype=np.int32), len(fps))
            value = np.concatenate([values_of(fps, bits) for _, _, bits in flat]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value)], ["part", "value"])

    sizes = nodes.select("fp").mapInArrow(run, "part int, value long").groupBy("part", "value").count()
    pairs = {r["part"]: float(r["pairs"]) for r in sizes.groupBy("part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    options = []
    for m in PARTITIONS:
        costs = []
        for i, (mm, _, bits) in enumerate(flat):
            if mm != m:
                continue
            # candidates at threshold 0 are counted; for larger ones they grow as for independent bits
            chance = within(p[bits], DISTANCE)
            costs.append([0.0] + [pairs.get(i, 0.0) * chance[t] / max(chance[0], 1e-300) / 2 * 0.01 + balls(len(bits), t) * n for t in range(DISTANCE + 1)])
        options.append((*allocated(costs, DISTANCE - m + 1), m))
    _, thresholds, m = min(options)
    return [(bits, t) for bits, t in zip(groups[m], thresholds, strict=True) if t >= 0]


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct fingerprints in one bucket: each one that is linked to others, and the smallest it reaches."""
    if len(fps) <= AT_ONCE:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= _DISTANCE
        root = near.argmax(axis=1)
        while True:
            new = np.where(near, root[None, :], len(fps)).min(axis=1)
            new = new[new]
            if (new == root).all():
                break
            root = new
    else:
        root, left = np.arange(len(fps)), np.arange(1, len(fps))
        queue, k, start = [0], 0, 0
        while True:
            while k < len(queue) and len(left):
                hit = np.bitwise_count(fps[left] ^ fps[queue[k]]) <= _DISTANCE
                k += 1
                if hit.any():
                    found = left[hit]
                    root[found] = start
                    queue += found.tolist()
                    left = left[~hit]
            if not len(left):
                break
            start, left = int(left[0]), left[1:]
            queue, k = [start], 0
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def forest_edges(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """u, v: links that connect what the links of each bucket connect; v is the smallest of its bucket. nodes: fp, distinct."""
    spark = nodes.sparkSession
    prepared(spark)

    def probes(batches):
        for b in batches:
            fps = np.asarray(b.column("fp")).view(np.uint64)
            for k, (bits, radius) in enumerate(parts):
                own = values_of(fps, bits)
                flips = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(len(bits)), r)]
                for flip in flips:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((own ^ np.uint64(flip)).view(np.int64)), pa.array(fps.view(np.int64))], ["part", "value", "fp"])

    rows = nodes.select("fp").mapInArrow(probes, "part int, value long, fp long")
    hot = rows.groupBy("part", "value").count().where(F.col("count") > BUCKET).select("part", "value", F.ceil(F.col("count") * 2 / BUCKET).cast("int").alias("chunks"))
    hot = checkpointed(hot)
    if hot.isEmpty():
        rows = rows.withColumn("pair", F.lit(0))
    else:  # large buckets: all chunks meet two by two
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, F.col("own")) * F.col("chunks") + F.greatest(c, F.col("own")))
        joined = rows.join(hot, ["part", "value"], "left").withColumn("own", own)
        rows = joined.select("part", "value", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(meets)).alias("pair"))

    def link(batches):
        got = [(np.asarray(b.column("part")), np.asarray(b.column("value")), np.asarray(b.column("pair")), np.asarray(b.column("fp"))) for b in batches if b.num_rows]
        if not got:
            return
        part, value, pair, fp = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((fp, pair, value, part))
        part, value, pair, fp = part[order], value[order], pair[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])]))
        ends = np.concatenate([new[1:], [len(fp)]])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        many = ends - new > 1
        for a, b in zip(new[many].tolist(), ends[many].tolist(), strict=True):
            u, v = forest(fp[a:b].view(np.uint64))
            if len(u):
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        for a in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + 50_000, 0]), pa.array(pairs[a : a + 50_000, 1])], ["u", "v"])

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "part", "value", "pair").mapInArrow(link, "u long, v long").distinct()


def spread_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """The join of rows with the one row of their key. A key of more than JOIN_ROWS rows is dealt over as many tasks as it needs, and its row copied there.

    Such keys are at most one per JOIN_ROWS rows, and are counted with partial sums before anything is shuffled.
    """
    hot = checkpointed(many.groupBy(key).count().where(F.col("count") > JOIN_ROWS).select(key, F.ceil(F.col("count") / JOIN_ROWS).cast("int").alias("__parts")))
    if hot.isEmpty():
        return many.join(one, key)
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), parts).cast("int")).drop("__parts")
    right = one.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def components(edges: DataFrame) -> DataFrame:
    """v, root: every node with an edge but the smallest of its component, and that smallest one. edges: u, v.

    Alternates large-star (larger neighbours move to the smallest neighbour) and small-star (smaller neighbours
    and the node itself move to the smallest), until the edges stay as they are. Nodes and links stay in Spark; a
    step joins each edge with the minimum of its end, so no neighbourhood is gathered in one row.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("root")).where("v <> root").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("v").alias("a"), F.col("root").alias("b")).unionAll(edges.select(F.col("root").alias("a"), F.col("v").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.where("b > a"), least, "a").select(F.col("b").alias("v"), F.col("m").alias("root")).where("v <> root").distinct()
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("root")), F.struct(F.col("root").alias("v"), F.col("m").alias("root")))).alias("e")).select("e.v", "e.root")
        edges = checkpointed(small.where("v <> root").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges


def grouped(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of a frame with doc_id and text.

    component_id is the smallest doc_id that links reach, the row's own included; null where all ids of the
    component are null. Null texts have no words and the fingerprint 0, which links like any other. Repeated rows
    are nodes with equal fingerprints. Columns other than doc_id and text aren't read.
    """
    fps = checkpointed(fingerprints(df))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(forest_edges(nodes, plan(nodes)))
    labelled = nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    known = spread_join(labelled.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(fps, known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document of each group: that with the smallest doc_id. Rows without an id stay; of rows with equal ids that with the smallest hash of all its columns."""
    gone = grouped(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    rest = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    single = rest.join(again, "doc_id", "left_semi").select("*", first.alias("__first")).where("__first = 1").drop("__first")
    return rest.join(again, "doc_id", "left_anti").unionByName(single)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every whole document."""
    return grouped(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
