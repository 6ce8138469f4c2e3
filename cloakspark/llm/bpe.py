"""BPE encoding and decoding by a contiguous rank array.

A word of the text is a short array of symbols. Beside it stands the array of the merge ranks of adjacent
symbols. The smallest rank is searched by a scan, its boundary is deleted and the two neighbouring ranks are
refreshed, until no adjacent pair has a rank. Words longer than `LONG_WORD` symbols use a heap over a linked
list instead, as repeated scans of a long array cost the square of its length; both give the same merges.

The vocabulary file is a parameter. It is never trained here and never copied into the repository.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cloakspark.llm._common import map_batches, table, texts_of

#: Symbols from which a word is merged with a heap.
LONG_WORD = 96
#: Words whose encoding a worker remembers as young; when full they become the old ones, and the old ones go.
REMEMBERED_WORDS = 200_000
#: Above every rank of a merge.
NO_RANK = 1 << 40
#: Unicode White_Space, which is what the vocabulary's normaliser takes as white space.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
#: Code points that the regex module's Unicode version counts as letters or digits and the tokenizers library's doesn't yet.
NEWER = r"՘֋-֌࢏౜೜Ᲊ₏₝-₟Ɤ-Ꟍ꟎-꟏꟒꟔ꟚꟜ-꟝꟢꟱꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010d50-\U00010d65\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Bpe:
    """Encoder and decoder of a vocabulary with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        #: (left id << 32 | right id) to rank, and the symbol that each rank makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[left] << 32 | self.ids[right]] = r
            self.made.append(self.ids[left + right])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.ascii_words = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9"), re.ASCII)
        self.newer = regex.compile(f"[{NEWER}]")
        self.strict_words = regex.compile(pattern.replace(r"\s", SPACE).replace(r"\p{L}\p{N}", rf"[\p{{L}}\p{{N}}--[{NEWER}]]").replace(r"[\p{L}]", rf"[\p{{L}}--[{NEWER}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{NEWER}]]"), regex.V1)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.bytes = byte_symbols()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _symbols(self, word: str) -> list[int]:
        shown = [self.bytes[b] for b in word.encode("utf-8")]
        shown[-1] += self.suffix
        return [self.ids[s] for s in shown]

    def merge_scanned(self, parts: list[int]) -> list[int]:
        """The contiguous array: scan the ranks for the minimum, drop a boundary, refresh the neighbours."""
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NO_RANK)
        return parts

    def merge_heaped(self, parts: list[int]) -> list[int]:
        """The same merges for long words, in n log n steps."""
        rank, made, n = self.rank.get, self.made, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = made[best], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(parts[i] << 32 | parts[after[i]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := rank(parts[before[i]] << 32 | parts[i], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[bytes, str]:
        """Of one word: its ids as little-endian bytes, and its tokens' strings joined by a space."""
        found = self.older.get(word)
        if found is None:
            parts = self._symbols(word)
            parts = self.merge_scanned(parts) if len(parts) <= LONG_WORD else self.merge_heaped(parts)
            found = (struct.pack(f"<{len(parts)}I", *parts), " ".join([self.strings[p] for p in parts]))
        if len(word) <= LONG_WORD:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: normalised, cut by the vocabulary's pattern."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # lower case by character, without final sigma
        try:
            text.encode("latin-1")  # quicker than the search, and true of most texts
        except UnicodeEncodeError:
            if self.newer.search(text):
                return self.strict_words.findall(text)
        return self.words.findall(text)

    def encode(self, text: str) -> list[tuple[bytes, str]]:
        """The pieces of a whole text in order, each its ids and strings; special tokens in it are pieces of their own."""
        pieces: list[tuple[bytes, str]] = []
        at = 0
        for m in self.specials.finditer(text) if "<|" in text else ():
            pieces += self._pieces(text[at : m.start()])
            pieces.append((struct.pack("<I", self.special[m[0]]), m[0]))
            at = m.end()
        return pieces + self._pieces(text[at:]) if at else self._pieces(text)

    def _pieces(self, text: str) -> list[tuple[bytes, str]]:
        known, word = self.known.get, self.word
        return [known(w) or word(w) for w in self.split(text)]

    def ids_of(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return np.frombuffer(b"".join([p[0] for p in self.encode(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids, joined by a space: the vocabulary has no decoder of its own."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Token ids and decoded text of every row: id, ids (array<int>), decoded (string).

    Null and empty texts give no ids and an empty decoded text. Rows stay as they are: none is merged, dropped
    or sorted; null ids and repeated rows pass through. Only `id_col` and `text_col` are read, so other columns
    cannot clash. With `full=False`, digests stand in place of ids and text (see SCHEMA), so that nothing large
    leaves the worker.
    """

    def make():
        bpe = _loaded(path)

        def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded = [], [], []
            for text in texts_of(batch):
                pieces = bpe.encode(text)
                raw = b"".join([p[0] for p in pieces])
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            pieces = [bpe.encode(text) for text in texts_of(batch)]
            ids = [np.frombuffer(b"".join([p[0] for p in ps]), "<u4").astype("i4") for ps in pieces]
            decoded = [" ".join([p[1] for p in ps]) for ps in pieces]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

        return whole if full else digest

    rows = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return map_batches(rows, make, "doc_id long, ids array<int>, decoded string" if full else SCHEMA)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole document."""
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path(), full=False)


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
