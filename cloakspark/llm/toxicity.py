"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words, and their first 4, 5 and 6 bytes as stems, are hashed to rows of an embedding table; a word's embedding is
the sum of its rows. Filters of several widths run over the word sequence, each is
max-pooled over the whole text, and a logistic layer joins them. As filters are linear in the embeddings, scoring
reads precomputed rows (embedding times filter slice) and adds them. The probability is then mapped, for each
language guessed from function words of the text, so that the threshold found for that language on the training
fold lands on FLAG_FROM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloakspark.llm._common import held_out, labelled, map_batches, table, texts_of

#: Labelled documents that the classifier is fitted on, at most.
TRAIN_ROWS = 10_000
#: A document is flagged from this score on.
FLAG_FROM = 0.7
MODULUS, REST = 3, 1
BITS, DIM = 18, 8
#: Texts of the training fold in which a bucket must occur to be learnt; others count as padding, as they would only be memorised.
LEAST_TEXTS = 5
#: Filters by width.
FILTERS = {1: 8, 2: 4, 3: 4}
EPOCHS, BATCH, RATE, DECAY = 5, 64, 0.01, 1e-4
#: Bytes of a text that are hashed at once; segments end between words.
SEGMENT_BYTES = 1 << 20
#: Bytes of the stems that are hashed beside the word.
STEMS = (4, 5, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as on be by at are this from or have an they which",
    "de": "der die und das den dem nicht ein eine ist von mit sich auf für auch als nach wie im bei oder",
    "fr": "le la les des et est une du que qui dans pour sur pas par avec sont au ce il elle nous ou",
    "es": "el los las del y en que por una con para es al como su más pero se lo sus este ha",
}

#: 1 for bytes of words: letters, digits and all beyond ASCII.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_STEP = 0x100000001B3


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP and its inverse modulo 2**64 to the powers 0..n-1."""
    inverse = pow(_STEP, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.array([1, *[k] * (n - 1)], np.uint64)) for k in (_STEP, inverse))


_POWER, _INVERSE = _powers(SEGMENT_BYTES + 1)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of each word in lower-case bytes (SEGMENT_BYTES at most): of the word and of its stems, 0 where it is shorter."""
    inside = np.concatenate([[False], _WORD_BYTE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)], dtype=np.uint64)])
        back = _INVERSE[start]
        columns = [(sums[end] - sums[start]) * back * np.uint64(_MULTIPLIER)]
        for n in STEMS:
            stem = (sums[np.minimum(start + n, len(raw))] - sums[start]) * back + np.uint64(n)
            columns.append(np.where(start + n <= end, stem * np.uint64(_MULTIPLIER), np.uint64(0)))
    return np.stack(columns, axis=1)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a whole text, lower-cased: a row per word, with its stems."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out, at = [], 0
    while len(raw) - at > SEGMENT_BYTES:
        gaps = np.flatnonzero(~_WORD_BYTE[raw[at : at + SEGMENT_BYTES]])
        end = at + (int(gaps[-1]) + 1 if len(gaps) else SEGMENT_BYTES)
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate([*out, _hashes(raw[at:])]) if out else _hashes(raw)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Rows of the embedding table; row 0 is padding."""
    return np.where(hashes != 0, (hashes >> np.uint64(64 - BITS)).astype(np.int32) + 1, 0)


_LANGUAGES = [*FUNCTION_WORDS, ""]
_FUNCTION = sorted((int(word_hashes(w)[0, 0]), k) for k, lang in enumerate(FUNCTION_WORDS) for w in FUNCTION_WORDS[lang].split())
_FUNCTION_HASH = np.array([h for h, _ in _FUNCTION], np.uint64)
_FUNCTION_LANG = np.array([k for _, k in _FUNCTION])


def language(hashes: np.ndarray) -> int:
    """Number of the language with most function words in the text; the last for none."""
    hashes = hashes[:, 0]
    at = np.minimum(np.searchsorted(_FUNCTION_HASH, hashes), len(_FUNCTION_HASH) - 1)
    found = _FUNCTION_LANG[at[_FUNCTION_HASH[at] == hashes]]
    return int(np.bincount(found).argmax()) if len(found) else len(_LANGUAGES) - 1


def _joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words of some texts, each text followed by padding, and where each text starts."""
    pad = np.zeros((max(FILTERS), 1 + len(STEMS)), np.int32)
    starts = np.concatenate([[0], np.cumsum([len(i) + len(pad) for i in ids])[:-1]]).astype(np.int64)
    return np.concatenate([x for i in ids for x in (i, pad)]), starts


@dataclass
class Network:
    """Row of each bucket, embedding (row 0 zero), filters by width as (width * DIM, count), logistic layer, thresholds by language."""

    row: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: np.ndarray

    def table(self) -> np.ndarray:
        """The contribution of each row at each place of each filter, side by side."""
        return np.concatenate([self.embedding @ w[k * DIM : (k + 1) * DIM] for width, w in self.filters.items() for k in range(width)], axis=1)

    def probability(self, ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Of each text, given the buckets of its words and stems."""
        joined, starts = _joined(ids)
        # places of a text end with its first padding, as in training: further ones would reach into the next text
        places = np.stack([starts, [*starts[1:], len(joined)]], axis=1) - [0, max(FILTERS) - 1]
        rows = self.row[joined]
        parts = table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            parts += table[rows[:, k]]
        pooled, at = [], 0
        for width, w in self.filters.items():
            n = w.shape[1]
            f = parts[:, at : at + n].copy()
            for k in range(1, width):
                f[:-k] += parts[k:, at + k * n : at + (k + 1) * n]
            pooled.append(np.maximum.reduceat(f, places.ravel(), axis=0)[::2])
            at += width * n
        x = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(x.astype(float) @ self.weight + self.offset, -40, 40)))

    def score(self, p: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Probabilities mapped so that the threshold of the language lands on FLAG_FROM; the order in a language stays."""
        t = self.thresholds[lang]
        return np.where(p < t, FLAG_FROM * p / t, FLAG_FROM + (1 - FLAG_FROM) * (p - t) / (1 - t))


def fit(texts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Network:
    """The network for texts given as buckets. The first embedding coordinate starts as the shrunk log-odds of a bucket's texts."""
    rng = np.random.default_rng(seed)
    rows, width = 2**BITS + 1, sum(FILTERS.values())
    emb = rng.normal(0, 0.05, (rows, DIM))
    sets = [np.unique(t) for t in texts]
    both = [np.bincount(np.concatenate([s for s, v in zip(sets, y, strict=True) if v == k] or [np.zeros(0, np.int64)]).astype(np.int64), minlength=rows) for k in (0, 1)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    # log-likelihood ratio of "no more toxic than the rest", signed: rare buckets stay near zero
    n, k = both[0] + both[1], both[1]
    expected = n * share
    emb[:, 0] = np.clip((k - expected) / np.sqrt(n * share * (1 - share) + 4.0) / 4, -1, 2)
    learnt = n >= LEAST_TEXTS
    learnt[0] = False
    emb[~learnt] = 0
    # learnt buckets alone get rows; the rest share row 0
    row = np.where(learnt, np.cumsum(learnt), 0).astype(np.int32)
    emb, texts = np.concatenate([np.zeros((1, DIM)), emb[learnt]]), [row[t] for t in texts]
    rows = len(emb)
    filters = {w: rng.normal(0, 0.3, (w * DIM, c)) for w, c in FILTERS.items()}
    for w in filters.values():
        w[::DIM] += 0.5
    bias, weight, offset = np.zeros(width), np.full(width, 0.1), float(np.log(share / (1 - share)))
    params: list[np.ndarray] = [*filters.values(), bias, weight]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    emb_square = np.full((rows, 1), 1e-6)
    step, reach = 0, max(FILTERS)
    positive = max(1.0, min(4.0, (1 - share) / share))
    for _ in range(EPOCHS if 0 < y.sum() < len(y) else 0):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            joined, starts = _joined([texts[i] for i in at])
            e = emb[joined].sum(axis=1)
            pooled, where = [], []
            for n, w in filters.items():
                f = e @ w[:DIM]
                for k in range(1, n):
                    f[:-k] += e[k:] @ w[k * DIM : (k + 1) * DIM]
                ends = [*starts[1:], len(joined)]
                top = np.stack([f[a : b - reach + 1].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
                pooled.append(np.take_along_axis(f, top, axis=0))
                where.append(top)
            z = np.concatenate(pooled, axis=1) + bias
            x = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(x @ weight + offset, -40, 40)))
            d = (p - y[at]) * np.where(y[at] > 0, positive, 1.0) / len(at)
            dx = d[:, None] * weight * (z > 0)
            grads, c, touched, changes = [], 0, [], []
            for (n, w), top in zip(filters.items(), where, strict=True):
                g, part = np.zeros_like(w), dx[:, c : c + w.shape[1]]
                for k in range(n):
                    seen = e[top + k]
                    g[k * DIM : (k + 1) * DIM] = np.einsum("bcd,bc->dc", seen, part)
                    hit = joined[top + k].reshape(-1, joined.shape[1])
                    touched.append(hit.ravel())
                    changes.append(np.repeat((part[:, :, None] * w[k * DIM : (k + 1) * DIM].T).reshape(-1, DIM), hit.shape[1], axis=0))
                grads.append(g)
                c += w.shape[1]
            grads += [dx.sum(axis=0), x.T @ d]
            step += 1
            for q, g, (m, v) in zip(params, grads, state, strict=True):
                g = g + DECAY * q
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            offset -= RATE * d.sum() * 4
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            change = np.zeros((len(ids), DIM))
            np.add.at(change, back, np.concatenate(changes))
            emb_square[ids] += (change**2).mean(axis=1, keepdims=True)
            emb[ids] -= RATE * change / np.sqrt(emb_square[ids])
            emb[0] = 0
    return Network(row, emb.astype(np.float32), {n: w.astype(np.float32) for n, w in filters.items()}, bias.astype(np.float32), weight, offset, np.full(len(_LANGUAGES), 0.5))


def calibrate(p: np.ndarray, y: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """By language the threshold with the best F1 on the training fold; languages with few of either label take that of all."""

    def best(p: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-p)
        hits, made = np.cumsum(y[order]), np.arange(1, len(y) + 1)
        k = int((2 * hits / (made + y.sum())).argmax())
        below = p[order[k + 1]] if k + 1 < len(p) else 0.0
        return float(np.clip((p[order[k]] + below) / 2, 0.05, 0.95))

    every = best(p, y) if y.any() else 0.5
    out = np.full(len(_LANGUAGES), every)
    for k in range(len(_LANGUAGES)):
        m = lang == k
        if y[m].sum() >= 20 and (1 - y[m]).sum() >= 20:
            out[k] = best(p[m], y[m])
    return out


def fitted(spark: SparkSession, sf_dir: str) -> Network:
    """The network fitted on at most TRAIN_ROWS labelled documents outside the held-out fold: a fifth of them sets the thresholds."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [word_hashes(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([buckets(h).tobytes() for h in hashes], pa.binary()), pa.array([language(h) for h in hashes], pa.int32()), batch.column("y")], ["doc_id", "ids", "lang", "y"])

        return each

    rows = map_batches(labelled(spark, sf_dir, "toxic", MODULUS, REST, TRAIN_ROWS), make, "doc_id long, ids binary, lang int, y int").toArrow().sort_by("doc_id")
    texts = [np.frombuffer(b, np.int32).reshape(-1, 1 + len(STEMS)) for b in rows["ids"].to_pylist()]
    y, lang = np.array(rows["y"].to_pylist(), float), np.array(rows["lang"].to_pylist(), int)
    return trained(texts, y, lang)


def trained(texts: list[np.ndarray], y: np.ndarray, lang: np.ndarray) -> Network:
    """Fit on four fifths and set the thresholds on the rest; with few positives, on all."""
    if not len(y):
        return fit([np.zeros((0, 1 + len(STEMS)), np.int32)], np.zeros(1))
    rest = np.arange(len(y)) % 5 == 4
    if y[rest].sum() < 10:
        rest[:] = False
    net = fit([t for t, r in zip(texts, rest, strict=True) if not r], y[~rest])
    on = rest if rest.any() else ~rest
    some, tables = np.flatnonzero(on), net.table()
    p = np.concatenate([net.probability([texts[i] for i in part], tables) for part in np.array_split(some, len(some) // 256 + 1)])
    net.thresholds = calibrate(p, y[some], lang[some])
    return net


def scored(df: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty, null ids pass through as not held out.

    Rows are scored one by one, so repeated rows get equal scores; columns other than doc_id and text aren't read.
    """

    def make():
        tables = net.table()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [word_hashes(t) for t in texts_of(batch)]
            lang, p, at = np.array([language(h) for h in hashes]), [], 0
            ids = [buckets(h) for h in hashes]
            while at < len(ids):  # about 300,000 words at once
                end, words = at + 1, len(ids[at])
                while end < len(ids) and words + len(ids[end]) <= 300_000:
                    words += len(ids[end])
                    end += 1
                p.append(net.probability(ids[at:end], tables))
                at = end
            score = net.score(np.concatenate(p), lang)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= FLAG_FROM).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

        return each

    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), held_out("doc_id", MODULUS, REST).alias("held_out"), df["text"].cast("string").alias("text"))
    return map_batches(rows, make, SCHEMA)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole document."""
    return scored(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
