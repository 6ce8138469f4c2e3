"""Removal of repeated passages by suffix arrays.

Every byte covered by a LENGTH-byte string that also starts earlier in the corpus goes. Strings that can repeat are
brought together like this:

1. The smallest hash of the GRAM-byte grams in a LENGTH-byte window is the window's key; equal windows have equal
   keys. Neighbouring windows with one key form a stretch. Stretches travel as hashes, packed, by key.
2. Of stretches with equal content (by 128 bits of hashes) all but the first are covered whole. Where a key has
   stretches of different content, the first of each content is asked for its bytes, and so is one that may hold a
   window twice.
3. The bytes come from a join with the documents. Stretches of a key are joined to one string; its suffix array is
   built by linear grouping, and neighbouring suffixes with LENGTH common bytes are the repeated windows.
4. Covered ranges are merged by document and cut out.

A line that very many documents hold between different texts gives a key very many contents. Such keys are counted
first, in all documents, and are cut before they travel: windows that hold the key's gram at nearly the same place
(STEP places) share all but STEP - 1 bytes on either side, and the hash of those shared bytes is their new key. So equal
windows still meet, different surroundings part, and the rest of the way is the same for all keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakspark.llm._common import checkpointed, prepared, table
from cloakspark.llm.suffix_array import suffix_array

LENGTH = 100
#: Bytes of the grams whose smallest hash is a window's key, and how many of them a window has.
GRAM = 40
GRAMS = LENGTH - GRAM + 1
#: Windows of a stretch, at most.
STRETCH = 64
#: Contents of a key from which it is cut: HOT, or this share of all stretches, so that no more than 1 / HOT_SHARE keys are sent to all tasks (8 bytes each). Keys of fewer than LOCAL contents in a task aren't counted.
HOT, HOT_SHARE, LOCAL = 2_000, 1e-6, 64
#: Places of a gram that windows of a cut key share, and the bytes that such windows have in common.
STEP = 8
CORE = LENGTH - STEP + 1
#: Bytes of text that are hashed at once, that go into one suffix array, and beyond which the windows of a key are dealt to several arrays by their hash.
SEGMENT, ARRAY, LARGE = 1 << 20, 1 << 16, 1 << 21
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_STEP = 0x2545F4914F6CDD1D
_NO_ID = (1 << 63) - 1  # stands for a null id, which comes last
_STRETCH = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("windows", "u1"), ("periodic", "u1")])
_WANTED = np.dtype([("key", "<u8"), ("at", "<u4"), ("windows", "u1")])
_GIVEN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<u4"), ("windows", "u1"), ("size", "u1")])


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _powers(SEGMENT + LENGTH)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _numbers(1 << max(21, size.bit_length()))


@lru_cache(maxsize=2)
def _numbers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of _STEP modulo 2**64, of its inverse, at least so many, and a random number for each byte value."""
    powers = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, k, np.uint64)])) for k in (_STEP, pow(_STEP, -1, 1 << 64))]
    return powers[0], powers[1], np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def stretches(raw: np.ndarray, ends: np.ndarray, hot: np.ndarray, counting: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, key and content hash of the stretches of texts laid end to end (SEGMENT + LENGTH bytes at most).

    Last, whether the key's gram stands more than once in the stretch, without which it can't hold a window twice.
    ends: where each text ends. Windows don't cross texts. hot: keys, in order, whose stretches are cut.
    counting: the last is left out, as keys are only counted.
    """
    n = len(raw)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    if n < LENGTH:
        return none
    power, inverse, values = _constants()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power[:n], dtype=np.uint64)])
    grams = low = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    span = 1
    while span * 2 <= GRAMS:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < GRAMS:
        low = np.minimum(low[: span - GRAMS], low[GRAMS - span :])
    owner = np.searchsorted(ends, np.arange(n - LENGTH + 1), side="right")
    valid = np.arange(n - LENGTH + 1) + LENGTH <= ends[np.minimum(owner, len(ends) - 1)]
    change = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    change[1:] |= valid[1:] != valid[:-1]
    start = np.flatnonzero(change)
    length = np.diff(np.concatenate([start, [len(low)]]))
    start, length = start[valid[start]], length[valid[start]]
    if not len(start):
        return none
    pieces = -(-length // STRETCH)  # long stretches, of periodic text, are cut
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    k = np.arange(len(first)) - first
    start, rest = np.repeat(start, pieces) + k * STRETCH, np.repeat(length, pieces) - k * STRETCH
    windows = np.minimum(rest, STRETCH)
    key = low[start]
    if len(hot):
        cut = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        parts = [_cut(grams, int(a), int(w), k) for a, w, k in zip(start[cut], windows[cut], key[cut], strict=True)]
        if parts:
            begin, count, base, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
            shared = _mixed((sums[base + CORE] - sums[base]) * inverse[base] + (offset.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
            start, windows = np.concatenate([start[~cut], begin]), np.concatenate([windows[~cut], count])
            gram, key = np.concatenate([key[~cut], low[begin]]), np.concatenate([key[~cut], shared])
        else:
            gram = key
    else:
        gram = key
    content = _mixed((sums[start + windows + LENGTH - 1] - sums[start]) * inverse[start] + windows.astype(np.uint64) * np.uint64(_STEP))
    if counting:
        return start, windows, key, content, np.zeros(len(start), bool)
    enters = np.concatenate([[0], np.cumsum(grams[GRAMS - 1 :] == low)])
    periodic = ((sliding_window_view(grams, GRAMS)[start] == gram[:, None]).sum(axis=1) > 1) | (enters[start + windows] > enters[start + 1])
    return start, windows, key, content, periodic


def _cut(grams: np.ndarray, start: int, windows: int, key: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of a stretch whose windows hold the key's gram (its first place in the window) within STEP places: start, windows, where the shared bytes begin, and which STEP."""
    at = start + np.flatnonzero(grams[start : start + windows - 1 + GRAMS] == key)
    own = start + np.arange(windows)
    gram = at[np.searchsorted(at, own)]
    step = (gram - own) // STEP
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (step[1:] != step[:-1])]))
    return own[new], np.diff(np.concatenate([new, [windows]])), gram[new] - STEP * step[new], step[new]


_NONE_HOT = np.zeros(0, np.uint64)


def stretches_of(docs: list[tuple[int, int, bytes]], hot: np.ndarray = _NONE_HOT, counting: bool = False) -> np.ndarray:
    """All stretches of some documents (id, text hash, bytes)."""
    out = [np.zeros(0, _STRETCH)]

    def add(parts: list[tuple[int, int, int, bytes]]) -> None:
        raw = np.frombuffer(b"".join([p[3] for p in parts]), np.uint8)
        ends = np.cumsum([len(p[3]) for p in parts])
        start, windows, key, content, periodic = stretches(raw, ends, hot, counting)
        own = np.searchsorted(ends, start, side="right")
        rows = np.zeros(len(start), _STRETCH)
        first = ends - np.array([len(p[3]) for p in parts])
        rows["key"], rows["content"], rows["windows"], rows["periodic"] = key, content, windows, periodic
        rows["doc"], rows["text"] = np.array([p[0] for p in parts], np.int64)[own], np.array([p[1] for p in parts], np.int64)[own]
        rows["at"] = start - first[own] + np.array([p[2] for p in parts], np.int64)[own]
        out.append(rows)

    parts, size = [], 0
    for doc, text, raw in docs:
        for at in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):  # a long text in segments that share LENGTH - 1 bytes
            piece = raw[at : at + SEGMENT + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > SEGMENT and parts:
                add(parts)
                parts, size = [], 0
            parts.append((doc, text, at, piece))
            size += len(piece)
    if parts:
        add(parts)
    return np.concatenate(out)


def _packed(rows: np.ndarray) -> bytes:
    """Rows column by column, which compresses better than row by row."""
    return b"".join([rows[c].tobytes() for c in rows.dtype.names])


def _unpacked(packed: list[bytes], kind: np.dtype) -> np.ndarray:
    """The rows of several packed blocks."""
    sizes = [len(p) // kind.itemsize for p in packed]
    rows, at = np.zeros(sum(sizes), kind), 0
    for p, n in zip(packed, sizes, strict=True):
        start = 0
        for c in kind.names:
            rows[c][at : at + n] = np.frombuffer(p, kind[c], n, start)
            start += n * kind[c].itemsize
        at += n
    return rows


def _by_document(kind: int, doc: np.ndarray, text: np.ndarray, rows: np.ndarray) -> pa.RecordBatch | None:
    """A row per document with its packed rows: kind, doc, text, packed."""
    if not len(doc):
        return None
    order = np.lexsort((text, doc))
    doc, text, rows = doc[order], text[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]))
    packed = [rows[a:b].tobytes() for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind, np.int32)), pa.array(doc[new]), pa.array(text[new]), pa.array(packed, pa.binary())], ["kind", "doc", "text", "packed"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([start, start + size], axis=1).astype("<u4")


def _first(rows: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of `by` and place, whether each is the first of its kind, and whether it is another place than that first."""
    rows = rows[np.lexsort([rows[c] for c in ("at", "text", "doc", *reversed(by))])]
    first = np.ones(len(rows), bool)
    first[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in by])
    head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    elsewhere = np.logical_or.reduce([rows[c] != rows[c][head] for c in ("doc", "text", "at")]) if len(rows) else first
    return rows, first, elsewhere


def repeated_windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur more than once in some byte strings: number of the class, of the string, and place in it.

    The strings are laid end to end with separators; a suffix array by linear grouping brings equal windows together.
    """
    symbols: list[int] = []
    own, place, left = [], [], []
    for k, c in enumerate(contexts):
        symbols += [b + 1 for b in c]
        symbols.append(0)
        own.append(np.full(len(c) + 1, k))
        place.append(np.arange(len(c) + 1))
        left.append(np.arange(len(c), -1, -1))
    owner, at, room = np.concatenate(own), np.concatenate(place), np.concatenate(left)
    order = np.array(suffix_array(symbols))
    order = order[room[order] >= LENGTH]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = sliding_window_view(np.array(symbols, np.uint16), LENGTH)
    steps = [(a, min(a + 20_000, len(order) - 1)) for a in range(0, len(order) - 1, 20_000)]
    same = np.concatenate([(view[order[a:b]] == view[order[a + 1 : b + 1]]).all(axis=1) for a, b in steps])
    label = np.concatenate([[0], np.cumsum(~same)])
    many = np.bincount(label)[label] > 1
    return label[many], owner[order[many]], at[order[many]]


def shared_by(contexts: list[bytes]) -> list[int]:
    """Numbers of the strings that may hold a window of another one or one twice: those with a window whose hash occurs again."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    if len(raw) < LENGTH:
        return []
    power, inverse, values = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * power[: len(raw)], dtype=np.uint64)])
    ends = np.cumsum(sizes)
    inside = np.concatenate([np.arange(e - n, e - LENGTH + 1) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    hashes = (sums[inside + LENGTH] - sums[inside]) * inverse[inside]
    _, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.searchsorted(ends, inside, side="right")
    return np.unique(owner[n[which] > 1]).tolist()


def covered_in(rows: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, text and byte ranges of windows that stand earlier in another place. rows: _GIVEN of one or more keys, whose bytes are `contexts`."""
    label, own, at = repeated_windows(contexts)
    w = np.zeros(len(label), np.dtype([("label", "<i8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i8")]))
    w["label"], w["doc"], w["text"], w["at"] = label, rows["doc"][own], rows["text"][own], rows["at"][own] + at
    w, _, elsewhere = _first(w, "label")
    w = w[elsewhere]
    return w["doc"], w["text"], _ranges(w["at"], np.full(len(w), LENGTH))


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges (start, end) in order, overlapping and touching ones joined."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].astype(np.int64)
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ranges) - 1]])]], axis=1)


def _pack_by_key(rows: np.ndarray, buckets: int, contexts: list[bytes] | None = None) -> pa.RecordBatch | None:
    """A row per bucket of keys with its packed rows, and their bytes laid end to end."""
    if not len(rows):
        return None
    bucket = (rows["key"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    cuts = list(zip(new, [*new[1:], len(rows)], strict=True))
    data = [b"".join([contexts[i] for i in order[a:b].tolist()]) if contexts else b"" for a, b in cuts]
    return pa.RecordBatch.from_arrays([pa.array(bucket[new]), pa.array([_packed(rows[a:b]) for a, b in cuts], pa.binary()), pa.array(data, pa.binary())], ["bucket", "packed", "data"])


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys of so many different contents that their stretches are cut, in order. docs: row (a struct with text)."""
    prepared(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [_NONE_HOT], 0
        for b in batches:
            rows = stretches_of([(0, 0, raw) for raw in _raw(b.column("row"))], counting=True)
            n += len(rows)
            _, one = np.unique(rows["key"] ^ _mixed(rows["content"]), return_index=True)
            keys.append(rows["key"][one])
            if sum(map(len, keys)) > 1 << 23:  # a very large task is counted in parts
                yield from _many(np.concatenate(keys))
                keys = [_NONE_HOT]
        yield from _many(np.concatenate(keys))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n])], ["key", "n"])

    found = docs.select("row").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = checkpointed(found)
    total = found.where("key is null").first()
    least = max(HOT, HOT_SHARE * (total["n"] if total else 0))
    hot = [r["key"] for r in found.where((F.col("key").isNotNull()) & (F.col("n") > least)).select("key").collect()]
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def _many(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys that occur LOCAL times, and how often."""
    key, n = np.unique(keys, return_counts=True)
    key, n = key[n >= LOCAL], n[n >= LOCAL]
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def dealt(rows: np.ndarray, contexts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The windows of a key of very many contents, single, in parts of about LARGE bytes by their hash: equal windows are in one part."""
    parts = sum(map(len, contexts)) * STEP // LARGE + 1
    for p in range(parts):
        some, own = [], []
        for i, c in enumerate(contexts):
            for k in range(len(c) - LENGTH + 1):
                w = c[k : k + LENGTH]
                if zlib.crc32(w) % parts == p:
                    some.append((i, k))
                    own.append(w)
        if own:
            at = np.array(some)
            one = rows[at[:, 0]]
            one["at"] += at[:, 1].astype("<u4")
            yield one, own


def covered(docs: DataFrame) -> DataFrame:
    """doc, text, packed: byte ranges of documents that stand earlier. docs: doc, text (its hash), row (a struct with text)."""
    spark = docs.sparkSession
    prepared(spark)
    hot = hot_keys(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * 4
    per_document = "kind int, doc long, text long, packed binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = stretches_of(list(zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), _raw(b.column("row")), strict=True)), hot)
            rows, first, elsewhere = _first(rows, "key", "content")
            if (out := _pack_by_key(rows[first], buckets)) is not None:
                yield pa.RecordBatch.from_arrays([out.column(0), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), out.column(1)], ["bucket", "doc", "text", "packed"])
            # what stands earlier in the same batch needs no journey
            gone = rows[elsewhere]
            if (out := _by_document(0, gone["doc"], gone["text"], _ranges(gone["at"].astype(np.int64), gone["windows"] + np.int64(LENGTH - 1)))) is not None:
                bucket = (np.asarray(out.column(2)).view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *out.columns[1:]], ["bucket", "doc", "text", "packed"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = []
        for b in batches:
            known = b.filter(b.column("doc").is_valid())
            if len(known):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(known), np.int32)), known.column("doc"), known.column("text"), known.column("packed")], ["kind", "doc", "text", "packed"])
            packed += b.filter(b.column("doc").is_null()).column("packed").to_pylist()
        if not packed:
            return
        rows, first, elsewhere = _first(_unpacked(packed, _STRETCH), "key", "content")
        gone = rows[elsewhere]
        if (out := _by_document(0, gone["doc"], gone["text"], _ranges(gone["at"].astype(np.int64), gone["windows"] + np.int64(LENGTH - 1)))) is not None:
            yield out
        rows = rows[first]
        new = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        contents = np.bincount(which)[which] if len(rows) else which
        asked = (contents > 1) | (rows["periodic"] > 0)
        rows = rows[asked]
        wanted = np.zeros(len(rows), _WANTED)
        for c in ("key", "at", "windows"):
            wanted[c] = rows[c]
        if (out := _by_document(1, rows["doc"], rows["text"], wanted)) is not None:
            yield out

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, contexts = [], []
            for doc, text, raw, wants in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), _raw(b.column("row")), b.column("wanted").to_pylist(), strict=True):
                want = np.frombuffer(b"".join(wants), _WANTED)
                for key, at, windows in want.tolist():
                    context = raw[at : at + windows + LENGTH - 1]
                    rows.append((key, doc, text, at, windows, len(context)))
                    contexts.append(context)
            if (out := _pack_by_key(np.array(rows, _GIVEN), buckets, contexts)) is not None:
                yield out

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, data = [], []
        for b in batches:
            packed += b.column("packed").to_pylist()
            data += b.column("data").to_pylist()
        if not packed:
            return
        rows, raw = _unpacked(packed, _GIVEN), b"".join(data)
        ends = np.cumsum(rows["size"].astype(np.int64))
        starts = ends - rows["size"]
        order = np.lexsort((rows["at"], rows["text"], rows["doc"], rows["key"]))
        rows, starts, ends = rows[order], starts[order].tolist(), ends[order].tolist()
        new = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])).tolist() if len(rows) else []
        found: list[tuple] = []
        chosen: list[int] = []
        size = 0

        def array() -> None:
            # strings that share no window needn't be sorted
            some = [chosen[k] for k in shared_by([raw[starts[i] : ends[i]] for i in chosen])] if chosen else []
            if some:
                found.append(covered_in(rows[some], [raw[starts[i] : ends[i]] for i in some]))
            chosen.clear()

        for a, z in zip(new, [*new[1:], len(rows)], strict=True):
            seen: dict[bytes, int] = {}
            again = []
            for i in range(a, z):
                j = seen.setdefault(raw[starts[i] : ends[i]], i)
                if j != i and rows[i] != rows[j]:
                    again.append(i)
            if again:
                r = rows[again]
                found.append((r["doc"], r["text"], _ranges(r["at"].astype(np.int64), r["windows"] + np.int64(LENGTH - 1))))
            whole = sum(map(len, seen))
            if whole > LARGE:
                for one, contexts in dealt(rows[list(seen.values())], list(seen)):
                    if some := shared_by(contexts):
                        found.append(covered_in(one[some], [contexts[k] for k in some]))
                continue
            if size + whole > ARRAY:
                array()
                size = 0
            chosen += seen.values()
            size += whole
        array()
        if found:
            doc, text, ranges = (np.concatenate(c) for c in zip(*found, strict=True))
            if (out := _by_document(0, doc, text, ranges)) is not None:
                yield out

    # the hashing reads the text alone; the join below carries whole rows, so that the last join can use the same shuffle
    keyed = docs.select("doc", "text", F.struct("row.text").alias("row")).mapInArrow(hashed, "bucket int, doc long, text long, packed binary").repartition(partitions, "bucket")
    facts = keyed.mapInArrow(compared, per_document)
    wanted = facts.where("kind = 1").groupBy("doc", "text").agg(F.collect_list("packed").alias("wanted")).withColumnsRenamed({"doc": "d", "text": "t"})
    bytes_ = docs.join(wanted, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t"))).select("doc", "text", "row", "wanted").mapInArrow(given, "bucket int, packed binary, data binary")
    more = bytes_.repartition(partitions, "bucket").mapInArrow(sorted_out, per_document)
    return facts.where("kind = 0").unionByName(more).select("doc", "text", "packed")


def _raw(rows: pa.StructArray) -> list[bytes]:
    """The texts of some rows as bytes, null as empty."""
    return [(t or "").encode() for t in rows.field("text").to_pylist()]


def _with_ranges(df: DataFrame) -> DataFrame:
    """row (all columns of `df`), ranges (packed) and again (a row like an earlier one) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("text"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    gone = covered(docs).groupBy("doc", "text").agg(F.collect_list("packed").alias("ranges")).withColumnsRenamed({"doc": "d", "text": "t"})
    joined = docs.join(gone, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t")), "left")
    return joined.withColumn("again", F.row_number().over(Window.partitionBy("doc", "text").orderBy("doc")) > 1).select("row", "ranges", "again")


def _spans(raw: bytes, ranges: list[bytes] | None, again: bool) -> np.ndarray:
    """Maximal removed runs of a text; a row like an earlier one is covered whole."""
    if again and len(raw) >= LENGTH:
        return np.array([[0, len(raw)]])
    return merged(np.frombuffer(b"".join(ranges or []), "<u4").reshape(-1, 2))


def _rest(raw: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of a frame with doc_id and text.

    Null texts are empty; texts under LENGTH bytes keep all. Order is by doc_id, null ids last; rows with equal ids
    and different texts are ordered by the hash of the text, and of equal rows one comes first. Other columns aren't
    read.
    """
    rows = _with_ranges(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, ranges, again in zip(_raw(b.column("row")), b.column("ranges").to_pylist(), b.column("again").to_pylist(), strict=True):
                spans = _spans(raw, ranges, again)
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_rest(raw, spans)).hexdigest()))
            n, removed, spans, digest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("row").field("doc_id"), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, SCHEMA)


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` with the repeated passages cut out of text; n_chars, where there is one, follows the text.

    A character of which only some bytes go, goes whole. A null text stays null.
    """
    rows, names = _with_ranges(df).select("row.*", "ranges", "again"), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, ranges, again in zip(*(b.column(c).to_pylist() for c in ("text", "ranges", "again")), strict=True):
                raw = (text or "").encode()
                spans = _spans(raw, ranges, again)
                texts.append(text if not len(spans) else b"".join([p.encode() for p in _parts(raw, spans)]).decode())
            columns = {n: b.column(n) for n in names}
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    prepared(df.sparkSession)
    return rows.mapInArrow(run, df.schema)


def _parts(raw: bytes, spans: np.ndarray) -> list[str]:
    at, out = 0, []
    for a, b in [*spans.tolist(), (len(raw), len(raw))]:
        out.append(raw[at:a].decode("utf-8", "ignore"))
        at = b
    return out


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 100-byte strings leaves of every whole document."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_substrings": op7_substrings}
ORACLES: dict[str, str] = {}
