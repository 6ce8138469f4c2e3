"""Language-model scores: a hashed maximum-entropy model with class-factored softmax, over exact counts of the corpus.

A token's probability is that of its class, given the two tokens before it, times that of the token within its
class. The most frequent tokens form classes by frequency, whose members are told apart by features again; all
other tokens fall into classes by their last bytes, within which their smoothed counts decide, so that every
possible token has a probability. Features (the previous token, the one before it, and both) are hashed to
rows of two tables: one row gives a weight to every class, or to every member of one class.

Documents are read once. Tasks cut them into packs of some MB, in which tokens are numbers of the pack's own
list of distinct tokens; packs are written to the shared folder. Counts are sums over the packs' lists, all training
documents included. The most frequent tokens' counts are handed to every task, a number of fixed bound; those of all
others are joined to the packs' lists, and as such a token is rare, no key is hot.

Training goes over all training documents in rounds. In a round every task starts from the same weights, makes
gradient steps over its packs, and returns by how much each row changed and how often it was met; rows are
averaged by that, block by block, in Spark. Scores are sums over sparse numpy batches.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm._common import held_out, prepared, shared_folder, table

MODULUS, REST_OF = 7, 2
#: Classes of frequent tokens, tokens in each, and classes of all other tokens.
CLASSES, SIZE, REST = 48, 64, 16
#: Rows of the two weight tables, as powers of two.
CLASS_BITS, WORD_BITS = 13, 14
FEATURES = 3
#: Tokens whose counts every task gets, at most; a token beyond them is about one of so many tokens of the corpus, or less.
HEAD = 65_536
#: Bytes of text from which a pack is full.
PACK_BYTES = 8 << 20
#: Rounds of training, each over its share of all packs; tokens of a gradient step; step width; first sum of squares.
ROUNDS, BATCH, RATE, FIRST = 4, 2048, 0.15, 0.1
#: Sums of weights are cut here, so that powers of e stay in range; the least bias.
MOST, LEAST = 60.0, -60.0
#: Rows met up to so often in a batch are summed side by side, others one by one.
OFTEN = 8
#: Rows of a weight table that travel and are averaged together.
BLOCK = 256
#: Longer tokens are known by a digest, so that a list of tokens stays small.
LONG_TOKEN = 64
#: Packs that a task holds at once.
PACKS_AT_ONCE = 2
#: The end of a text; white space, so no word is equal to it.
END = b"\n"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PACK = "slice int, pack long, doc_ids array<long>, held array<boolean>, sizes array<int>, keys array<binary>, seen array<int>, ids binary"


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of a whole text in UTF-8, cut at the six ASCII white-space characters."""
    return text.translate(_LOWER).split()


def key_of(word: bytes) -> bytes:
    """What a token is counted under: itself, or for a long one a digest behind a space, which no word holds."""
    return word if len(word) <= LONG_TOKEN else b" " + hashlib.sha256(word).hexdigest().encode()


#: The class of a token that isn't among the frequent ones, by its last two bytes as a number.
_REST_OF_TAIL = np.array([zlib.crc32(k.to_bytes(2, "big")) % REST for k in range(1 << 16)], np.int64)
#: The same in Spark.
_REST_SQL = f"cast(crc32(lpad(substring(key, -2, 2), 2, X'00')) % {REST} as int)"


def rest_classes(keys: list[bytes]) -> np.ndarray:
    """The classes of tokens that aren't among the frequent ones."""
    return _REST_OF_TAIL[np.frombuffer(b"".join([k[-2:] if len(k) > 1 else b"\0" + k for k in keys]), ">u2")]


def packed(df: DataFrame) -> DataFrame:
    """Packs of documents (see _PACK). df: doc_id, held_out, text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        doc_ids, held, sizes, ids, size = [], [], [], [], 0

        def pack() -> pa.RecordBatch:
            at = np.concatenate(ids).astype("<i4")
            own = np.repeat(~np.array(held, bool), sizes)
            seen = np.bincount(at[own], minlength=len(number)).astype("i4")
            row = ((part + made) % ROUNDS, part << 32 | made, doc_ids, held, sizes, [key_of(w) for w in number], seen, at.tobytes())
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _PACK.split(", ")])

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                tokens = words(text or b"")
                tokens.append(END)
                ids.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
                doc_ids.append(doc_id)
                held.append(out)
                sizes.append(len(tokens))
                size += len(text or b"") + 1
                if size >= PACK_BYTES:
                    yield pack()
                    number.clear()
                    doc_ids, held, sizes, ids, size, made = [], [], [], [], 0, made + 1
        if doc_ids:
            yield pack()

    return df.mapInArrow(run, _PACK)


def counted(packs: DataFrame) -> DataFrame:
    """key, c: how often each token stands in training documents, by partial sums."""
    return packs.select(F.inline(F.arrays_zip("keys", "seen"))).where("seen > 0").groupBy(F.col("keys").alias("key")).agg(F.sum("seen").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the corpus that every task gets: of bounded size, whatever the corpus."""

    total: int
    distinct: int
    #: Frequent tokens, most frequent first, and their counts; the first CLASSES x SIZE are the model's own.
    keys: list[bytes]
    counts: np.ndarray
    #: Tokens and distinct tokens of each class of the others.
    rest_total: np.ndarray
    rest_distinct: np.ndarray

    @property
    def own(self) -> int:
        return min(len(self.keys), CLASSES * SIZE)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals over all counts, and the most frequent tokens, HEAD at most; which of equally frequent ones is the model's own is decided by the token."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the count from which on tokens are at most HEAD, by a few hundred ranges of counts: a sort would send each task's first ones
    step = F.when(F.col("c") < 64, F.col("c").cast("int")).otherwise((F.log2(F.col("c") / 64) * 16).cast("int") + 64)
    many, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["c"]):
        many += r["n"]
        if many > HEAD:
            break
        least = r["c"]
    head = [] if least is None else sorted(((r["c"], bytes(r["key"])) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    keys, c = [k for _, k in head], np.array([n for n, _ in head], np.int64)
    rest_total, rest_distinct = np.zeros(REST, np.int64), np.zeros(REST, np.int64)
    for r in counts.groupBy(F.expr(_REST_SQL).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        rest_total[r["k"]], rest_distinct[r["k"]] = r["n"], r["v"]
    own = rest_classes(keys[: CLASSES * SIZE])
    np.subtract.at(rest_total, own, c[: len(own)])
    np.subtract.at(rest_distinct, own, 1)
    return Vocabulary(total["n"], total["v"], keys, c, rest_total, rest_distinct)


class Tables:
    """Weights: biases of classes and of their members, and for each of both a row of weights per hashed feature with its sum of squares."""

    def __init__(self, arrays: list[np.ndarray]):
        self.class_bias, self.word_bias, self.classes, self.class_squares, self.words, self.word_squares = arrays

    @classmethod
    def of_counts(cls, v: Vocabulary) -> Tables:
        """No feature has a weight yet, and the biases give every token its share of the corpus."""
        own = np.zeros(CLASSES * SIZE)
        own[: v.own] = v.counts[: v.own] + 1.0
        own = own.reshape(CLASSES, SIZE)
        mass = np.concatenate([own.sum(axis=1), v.rest_total + 1.0])
        with np.errstate(divide="ignore"):
            word = np.maximum(np.log(own), LEAST)  # places without a token
            share = np.maximum(np.log(mass / mass.sum()), LEAST)
        word -= word.max(axis=1, keepdims=True)
        rows = lambda bits, width: [np.zeros((1 << bits, width), np.float32), np.full(1 << bits, FIRST, np.float32)]
        return cls([share.astype(np.float32), word.astype(np.float32), *rows(CLASS_BITS, CLASSES + REST), *rows(WORD_BITS, SIZE)])

    def arrays(self) -> list[np.ndarray]:
        return [self.class_bias, self.word_bias, self.classes, self.class_squares, self.words, self.word_squares]

    def copy(self) -> Tables:
        return Tables([a.copy() for a in self.arrays()])


class Softmax:
    """One weight table at work on batches, in buffers that are used again."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray):
        self.weights, self.squares, width = weights, squares, weights.shape[1]
        self.met = np.zeros(len(weights), np.int64)
        self.z, self.e, self.part = (np.empty((BATCH, width), np.float32) for _ in range(3))
        self.sums, self.old, self.many = (np.empty((FEATURES * BATCH, width), np.float32) for _ in range(3))
        self.ones = np.ones(max(width, FEATURES * BATCH), np.float32)

    def powers(self, bias: np.ndarray, bias_rows: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens x outputs: the sums of bias and all features' weights, their powers of e, and the sums of those."""
        n = rows.shape[1]
        z, e, part = self.z[:n], self.e[:n], self.part[:n]
        self.weights.take(rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            z += self.weights.take(r, axis=0, out=part, mode="clip")
        z += bias if bias_rows is None else bias.take(bias_rows, axis=0, out=part, mode="clip")
        np.minimum(z, MOST, out=z)
        np.exp(z, out=e)
        return z, e, e @ self.ones[: e.shape[1]]

    def learn(self, e: np.ndarray, total: np.ndarray, aim: np.ndarray, rows: np.ndarray) -> None:
        """One step: gradients of a batch are summed by row, and steps shrink with a row's sum of squares."""
        n = len(e)
        e *= (1 / total)[:, None]
        e[np.arange(n), aim] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        order %= n
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        length = np.diff(np.append(first, len(order)))
        u = len(first)
        sums, old, many = self.sums[:u], self.old[:u], e.take(order, axis=0, out=self.many[: len(order)], mode="clip")
        many.take(first, axis=0, out=sums, mode="clip")
        for j in range(1, OFTEN):
            again = np.flatnonzero((length > j) & (length <= OFTEN))
            if len(again):
                sums[again] += many[first[again] + j]
        long = np.flatnonzero(length > OFTEN)
        for i, f, m in zip(long.tolist(), first[long].tolist(), length[long].tolist(), strict=True):
            np.dot(self.ones[:m], many[f : f + m], out=sums[i])
        own = ordered[first].astype(np.int64)
        self.met[own] += length
        self.weights.take(own, axis=0, out=old, mode="clip")
        squares = self.squares[own] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        self.squares[own] = squares
        sums *= (RATE / np.sqrt(squares))[:, None]
        old -= sums
        self.weights[own] = old


def contexts(known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """features x tokens: what stands before every token, as numbers still to be hashed. known: the token's number, or its class for others."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(known)) - start
    known, before = known.astype(np.uint32), []
    for k in (1, 2):
        x = np.empty(len(known), np.uint32)
        x[k:] = known[: len(known) - k]
        x[at < k] = CLASSES * SIZE + REST  # before the text
        before.append(x)
    a, b = before
    five = np.uint32(5)
    return np.stack([a * five + np.uint32(1), b * five + np.uint32(2), (a * np.uint32(8191) + b) * five + np.uint32(3)])


def class_rows(f: np.ndarray) -> np.ndarray:
    """Rows of the class table for features, hashed in 32 bits."""
    return ((f * np.uint32(2654435761)) >> np.uint32(32 - CLASS_BITS)).astype(np.uint16)


def word_rows(f: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Rows of the member table for features within classes."""
    return (((f * np.uint32(64) + own.astype(np.uint32) + np.uint32(1)) * np.uint32(2246822519)) >> np.uint32(32 - WORD_BITS)).astype(np.uint16)


class Pack:
    """One pack as arrays: per token its number among the frequent ones (or -1), its class, its features and its count."""

    def __init__(self, row: dict, v: Vocabulary, rank: dict[bytes, int], tail: tuple[np.ndarray, np.ndarray] | None = None):
        keys = row["keys"]
        ranks = np.fromiter(map(rank.get, keys, repeat(-1)), np.int64, len(keys))
        count = np.where(ranks >= 0, v.counts[ranks] if len(v.counts) else 0, 0)
        if tail is not None:
            count[tail[0]] = tail[1]
        own = (ranks >= 0) & (ranks < v.own)
        others = rest_classes(keys)
        ids = np.frombuffer(row["ids"], "<i4")
        self.sizes = np.array(row["sizes"], np.int64)
        self.count = count[ids]
        self.word = np.where(own, ranks, -1)[ids]
        self.other = others[ids]
        self.cls = np.where(self.word >= 0, self.word // SIZE, CLASSES + self.other)
        features = contexts(np.where(self.word >= 0, self.word, CLASSES * SIZE + self.other), self.sizes)
        self.class_rows, self.word_rows = class_rows(features), word_rows(features, self.cls)


def scores(p: Pack, tables: Tables, v: Vocabulary, nets: tuple[Softmax, Softmax]) -> np.ndarray:
    """log10 probability of every token of a pack."""
    out = np.empty(len(p.word))
    for k in range(0, len(out), BATCH):
        s = slice(k, k + BATCH)
        cls, word = p.cls[s], p.word[s]
        z, _, total = nets[0].powers(tables.class_bias, None, p.class_rows[:, s])
        got = z[np.arange(len(cls)), cls].astype(np.float64) - np.log(total)
        own = np.flatnonzero(word >= 0)
        if len(own):
            z, _, total = nets[1].powers(tables.word_bias, cls[own], p.word_rows[:, s][:, own])
            got[own] += z[np.arange(len(own)), word[own] % SIZE] - np.log(total)
        out[s] = got / np.log(10)
    rest = p.word < 0
    k = p.other[rest]
    out[rest] += np.log10((p.count[rest] + 1) / (v.rest_total[k] + v.rest_distinct[k] + 1))
    return out


def taught(tables: Tables, nets: tuple[Softmax, Softmax], p: Pack, train: np.ndarray, seed: int) -> None:
    """Gradient steps over all training tokens of a pack, in a fixed random order."""
    todo = np.random.default_rng(seed).permutation(np.flatnonzero(train))
    for k in range(0, len(todo), BATCH):
        s = todo[k : k + BATCH]
        cls, word = p.cls[s], p.word[s]
        rows = p.class_rows[:, s]
        _, e, total = nets[0].powers(tables.class_bias, None, rows)
        nets[0].learn(e, total, cls, rows)
        own = np.flatnonzero(word >= 0)
        if len(own):
            rows = p.word_rows[:, s[own]]
            _, e, total = nets[1].powers(tables.word_bias, cls[own], rows)
            nets[1].learn(e, total, word[own] % SIZE, rows)


def nets_of(tables: Tables) -> tuple[Softmax, Softmax]:
    """Both tables, ready for batches."""
    return Softmax(tables.classes, tables.class_squares), Softmax(tables.words, tables.word_squares)


def _slices(values: pa.Array) -> list[bytes]:
    """The elements of a binary array, cut from its bytes at once."""
    values = values.cast(pa.binary())
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if len(values) else b""
    at = (at - at[:1]).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The packs of a batch; lists of numbers as arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name, cell in zip(batch.schema.names, (c[i] for c in batch.columns), strict=True):
            if name in ("ids", "pack"):
                row[name] = cell.as_py()
            elif name == "keys":
                row[name] = _slices(cell.values)
            elif name == "doc_ids":
                row[name] = cell.values  # ids may be null
            else:
                row[name] = cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None
        yield row


def _small_batches(spark: SparkSession, rows: int) -> str | None:
    """Bound the rows of an Arrow batch from now on; the bound before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return before


def trained(packs: DataFrame, v: Vocabulary) -> Tables:
    """Weights after ROUNDS rounds, which together go over all training documents once."""
    spark = packs.sparkSession
    tables = Tables.of_counts(v)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    for n in range(ROUNDS):
        sent = spark.sparkContext.broadcast((tables.arrays(), v))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            arrays, v = sent.value
            own = Tables(arrays).copy()
            nets = nets_of(own)
            rank = {k: i for i, k in enumerate(v.keys[: v.own])}
            for batch in batches:
                for row in _rows(batch):
                    p = Pack(row, v, rank)
                    taught(own, nets, p, np.repeat(~row["held"], p.sizes), row["pack"] % (1 << 31))
            for kind, (net, old, old_squares) in enumerate(((nets[0], arrays[2], arrays[3]), (nets[1], arrays[4], arrays[5]))):
                for k in range(0, len(old), BLOCK):
                    s = slice(k, k + BLOCK)
                    if net.met[s].any():
                        # weights in half precision, squares in single
                        change, squares = (net.weights[s] - old[s]).astype("<f2"), (net.squares[s] - old_squares[s]).astype("<f4")
                        cells = [pa.array([kind], pa.int32()), pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (change, squares, net.met[s].astype("<i8")))]
                        yield pa.RecordBatch.from_arrays(cells, ["kind", "block", "weights", "squares", "met"])

        def mixed(t: pa.Table) -> pa.Table:
            # all changes of one block, one row a task: the mean over the times that a row was met
            total, change = np.zeros((BLOCK, 1)), np.zeros((BLOCK, 1))
            for w, q, m in zip(*(t.column(c).to_pylist() for c in ("weights", "squares", "met")), strict=True):
                n_met = np.frombuffer(m, "<i8")[:, None]
                rows = np.concatenate([np.frombuffer(w, "<f2").reshape(BLOCK, -1).astype(np.float64), np.frombuffer(q, "<f4")[:, None]], axis=1)
                change, total = change + rows * n_met, total + n_met
            mean = (change / np.maximum(total, 1)).astype("<f4")
            return pa.table({"kind": t.column("kind")[:1], "block": t.column("block")[:1], "change": pa.array([mean.tobytes()], pa.binary())})

        share = packs.where(F.col("slice") == n).select("pack", "held", "sizes", "keys", "ids").coalesce(tasks)
        changes = share.mapInArrow(steps, "kind int, block int, weights binary, squares binary, met binary")
        got = changes.groupBy("kind", "block").applyInArrow(mixed, "kind int, block int, change binary").collect()
        tables = tables.copy()
        for r in got:
            weights, squares = (tables.classes, tables.class_squares) if r["kind"] == 0 else (tables.words, tables.word_squares)
            change, s = np.frombuffer(r["change"], "<f4").reshape(BLOCK, -1), slice(r["block"], r["block"] + BLOCK)
            weights[s] += change[:, :-1]
            squares[s] += change[:, -1]
        sent.unpersist()
    return tables


def tail_counts(packs: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """pack, at, c: for each pack the numbers and counts of its tokens beyond the HEAD most frequent ones, unseen ones left out."""
    spark = packs.sparkSession
    head = spark.createDataFrame([(bytearray(k),) for k in v.keys], "key binary")  # HEAD rows at most
    rows = packs.select("pack", F.posexplode("keys").alias("at", "key")).join(F.broadcast(head), "key", "left_anti")
    pairs = rows.join(counts, "key").groupBy("pack").agg(F.collect_list(F.struct("at", "c")).alias("found"))
    return pairs.select("pack", F.col("found.at").alias("at"), F.col("found.c").alias("c"))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df` (see SCHEMA): tokens, known tokens, base score and the model's log10 probability.

    Rows whose id is in the fold of `held_out` teach nothing: neither counts nor weights. Null texts count as empty, and
    an empty text is its end alone; null ids are training rows and pass through; repeated rows count and score each.
    Without any training row all counts are zero: base scores are 0 and the model is flat. An empty table gives no
    rows. Only `id_col` and `text_col` are read, so no other column can clash. Texts are never cut: a pack holds whole
    documents, a very long one alone.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/language-{uuid.uuid4().hex}"
    prepared(spark)
    id_, text = df[id_col], df[text_col]
    rows = df.select(id_.cast("long").alias("doc_id"), held_out(id_col, MODULUS, REST_OF).alias("held_out"), text.cast("string").cast("binary").alias("text"))
    packed(rows).write.option("compression", "zstd").partitionBy("slice").parquet(f"{folder}/packs")
    packs = spark.read.schema(_PACK).parquet(f"{folder}/packs")
    counted(packs).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    v = vocabulary(counts)
    before = _small_batches(spark, PACKS_AT_ONCE)
    try:
        sent = spark.sparkContext.broadcast((trained(packs, v).arrays(), v))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, v = sent.value
            tables, rank = Tables(arrays), {k: i for i, k in enumerate(v.keys)}
            nets = nets_of(tables)
            for batch in batches:
                for row in _rows(batch):
                    p = Pack(row, v, rank, None if row["at"] is None else (row["at"], row["c"]))
                    first = np.cumsum(p.sizes) - p.sizes
                    total = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731  no document is without a token
                    out = [
                        row["doc_ids"], pa.array(row["held"]), pa.array(p.sizes), pa.array(total((p.count > 0).astype(np.int64))), pa.array(np.full(len(first), v.total)),
                        pa.array(total(np.log10((p.count + 1) / (v.total + v.distinct + 1)))), pa.array(total(scores(p, tables, v, nets))),
                    ]
                    yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in SCHEMA.split(", ")])

        whole = packs.select("pack", "doc_ids", "held", "sizes", "keys", "ids").join(tail_counts(packs, counts, v), "pack", "left")
        whole.mapInArrow(each, SCHEMA).write.parquet(f"{folder}/scores")
    finally:
        if before is not None:
            _small_batches(spark, int(before))
    return spark.read.schema(SCHEMA).parquet(f"{folder}/scores")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, base score and model score of every whole document."""
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op12_language": op12_language}
ORACLES: dict[str, str] = {}
