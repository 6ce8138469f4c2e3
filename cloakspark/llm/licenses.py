"""License scan: fuzzy search of short notices.

A text becomes its words, joined by one space. A notice that may hold k edits is split into k + 1 pieces: by the
pigeonhole principle one of them stands in any match unchanged. An automaton finds all pieces of all notices in
one pass; around each hit the regex library matches the notice with at most k edits and reports its span. Words
that decide the label (names, versions) hold no edits. Phrases that must stand exactly are notices with no edits,
whose only piece is the phrase itself.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cloakspark.llm._common import map_batches, table, texts_of


@dataclass(frozen=True)
class Notice:
    """Text of a notice, the label it gives and the edits (of characters) it may hold. `exact` ones stand word by word.

    In `text` a word marked with * decides the label: it must stand as it is, as a word of its own.
    """

    text: str
    label: str
    edits: int

    @property
    def words(self) -> str:
        return self.text.replace("*", "")

    @property
    def exact(self) -> bool:
        return self.edits == 0

    @property
    def pattern(self) -> str:
        """Deciding words with the spaces around them as they are, the stretches between them with edits."""
        runs = re.findall(r"(?:\*\S+ ?)+|[^*]+", self.text)
        parts = []
        for run in runs:
            fuzzy = not run.startswith("*")
            words = run.replace("*", "").strip()
            parts.append(f"(?:{regex.escape(words)}){{e<={self.edits}}}" if fuzzy else f" {regex.escape(words)} ")
        return "(?b)" + "".join(parts)


#: Phrases of the contract: their words must stand consecutively.
BASE = (Notice("under the mit license", "mit", 0), Notice("apache license version 2", "apache-2", 0), Notice("cc by nc", "cc-by-nc", 0))
#: Licenses that short notices name.
NAMED = {"mit": "mit", "bsd": "bsd", "isc": "isc", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl"}
#: Short notices found with edits.
NOTICES = (
    *(Notice(f"released under the *{name} license", label, 3) for name, label in NAMED.items()),
    *(Notice(f"licensed under the *{name} license", label, 3) for name, label in NAMED.items()),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("licensed under the *apache license version *2 0", "apache-2", 4),
    Notice("licensed under the *gnu *general public license", "gpl", 4),
    Notice("*gnu *lesser *general public license", "lgpl", 3),
    Notice("*gnu *affero *general public license", "agpl", 3),
    Notice("*mozilla public license version *2 0", "mpl-2", 3),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under *cc *by 4 0", "cc-by", 2),
    Notice("licensed under *cc *by *nc 4 0", "cc-by-nc", 2),
    Notice("licensed under *cc *by *sa 4 0", "cc-by-sa", 2),
    Notice("licensed under *cc *by *nd 4 0", "cc-by-nd", 2),
    Notice("creative commons *attribution *noncommercial", "cc-by-nc", 4),
    Notice("creative commons *attribution *non *commercial", "cc-by-nc", 4),
    Notice("creative commons *attribution *sharealike", "cc-by-sa", 3),
    Notice("creative commons *attribution *share *alike", "cc-by-sa", 3),
    Notice("creative commons *attribution *4 0", "cc-by", 3),
    Notice("dedicated to the *public *domain", "public-domain", 3),
    Notice("all rights *reserved", "all-rights-reserved", 1),
)
#: Bytes that part words become a space; A-Z become a-z; all else stays.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = "label string, notice string, first_word long, last_word long, edits int"
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


@dataclass(frozen=True)
class Span:
    """A match: notice, start and end in the joined words, edits."""

    notice: Notice
    start: int
    end: int
    edits: int


def joined_words(text: str) -> tuple[str, int]:
    """The words of a whole text between single spaces, with one before and after, and how many there are."""
    words = text.encode("utf-8", "replace").translate(_CLEAN).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} ", len(words)


class Scanner:
    """Finds notices in joined words."""

    def __init__(self, notices: tuple[Notice, ...] = (*BASE, *NOTICES)):
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        self.notices = notices
        self.patterns: list[regex.Pattern | None] = []
        for k, n in enumerate(notices):
            whole = f" {n.words} "
            if n.exact:
                at.setdefault(whole, []).append((k, 0))
                self.patterns.append(None)
                continue
            size, pieces = len(whole), n.edits + 1
            for i in range(pieces):
                a, b = i * size // pieces, (i + 1) * size // pieces
                at.setdefault(whole[a:b], []).append((k, a))
            self.patterns.append(regex.compile(n.pattern))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), tuple(places)))
        if at:
            self.seeds.make_automaton()

    def spans(self, joined: str) -> list[Span]:
        """All matches in order of their start; of the notices with edits of one label those that don't overlap, the best first.

        Each hit of a piece is searched by itself, over the length of the notice and its edits, so a text of very many
        notices takes time in proportion to its length.
        """
        found: list[Span] = []
        close: dict[str, set[tuple[int, int, int, int]]] = {}
        searched: set[tuple[int, int]] = set()
        for end, (size, places) in self.seeds.iter(joined) if len(self.seeds) else ():
            for k, offset in places:
                n = self.notices[k]
                start = end + 1 - size - offset
                if n.exact:
                    found.append(Span(n, start + 1, start + 1 + len(n.words), 0))
                elif (k, start) not in searched:
                    searched.add((k, start))
                    m = self.patterns[k].search(joined, max(0, start - n.edits), min(len(joined), start + len(n.words) + 2 + n.edits))
                    if m and m.end() > m.start() and (edits := sum(m.fuzzy_counts)) <= n.edits:
                        # edits at the rim of a match are spaces of the neighbouring words
                        a = m.start() + len(m[0]) - len(m[0].lstrip(" "))
                        close.setdefault(n.label, set()).add((edits, a, m.start() + len(m[0].rstrip(" ")), k))
        for matches in close.values():
            taken: list[tuple[int, int]] = []
            for edits, a, b, k in sorted(matches):
                i = bisect.bisect(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.append(Span(self.notices[k], a, b, edits))
        return sorted(found, key=lambda s: (s.start, s.end, s.notice.words))


def word_numbers(joined: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Numbers of the first and last word of each span, counted from 0; spans in order of their start."""
    out, at, seen = [], 0, 0
    for s in spans:
        seen += joined.count(" ", at, s.start)
        at = s.start
        out.append((seen - 1, seen - 1 + joined.count(" ", s.start, s.end)))
    return out


def found_places(text: str, scanner: Scanner) -> list[tuple[str, str, int, int, int]]:
    """(label, notice, first word, last word, edits) of every match in a whole text, words counted from 0."""
    joined, _ = joined_words(text)
    spans = scanner.spans(joined)
    return [(s.notice.label, s.notice.words, first, last, s.edits) for s, (first, last) in zip(spans, word_numbers(joined, spans), strict=True)]


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of label, notice, words and edits) of every row, an empty array for none.

    Null texts count as empty, null ids and repeated rows pass through; only the two named columns are read.
    """

    def make():
        scanner = Scanner()
        spans = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[dict(zip(("label", "notice", "first_word", "last_word", "edits"), p, strict=True)) for p in found_places(t, scanner)] for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, spans)], ["doc_id", "spans"])

        return each

    rows = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return map_batches(rows, make, f"doc_id long, spans array<struct<{re.sub(r'(\w+) (\w+)', r'\1:\2', SPAN)}>>")


def digest(text: str, scanner: Scanner) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans ("label first-last edits;...", by words) of a whole text."""
    joined, n = joined_words(text)
    spans = scanner.spans(joined)
    base = [s for s in spans if s.notice.exact]
    at = word_numbers(joined, spans)
    places = [f for s, (f, _) in zip(spans, at, strict=True) if s.notice.exact]
    score = max([1 - s.edits / len(s.notice.words) for s in spans], default=0.0)
    said = ";".join([f"{s.notice.label} {f}-{e} {s.edits}" for s, (f, e) in zip(spans, at, strict=True)])
    return n, len(base), places[0] if base else None, places[-1] if base else None, ",".join(sorted({s.notice.label for s in base})), ",".join(sorted({s.notice.label for s in spans})), score, said


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: words, exact places of the contract's phrases, labels, score and spans.

    The score is 1 less the share of edited characters of the best match, 0 without a match. Null texts are empty
    (0 words, no label); null ids and repeated rows pass through; extra columns aren't read.
    """

    def make():
        scanner = Scanner()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*[digest(t, scanner) for t in texts_of(batch)], strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

        return each

    rows = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(rows, make, SCHEMA)


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
