"""All occurrences of many values in one pass over a text, by a trie automaton.

The result is that of replacing the values one after the other, each in what the ones before it left: a value counts
only outside of placeholders and of what earlier values replaced, ignoring case, and at an alphanumeric end only where
no word character follows. The automaton finds all candidates at once; they are then taken in order of the values.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import ahocorasick
import regex

from cloakspark.functions.patterns import PLACEHOLDER

_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]")
_EDGE = regex.compile(r"[\p{L}\p{N}]")
_HELD = regex.compile(PLACEHOLDER)


class _Fold(dict):
    """Characters without their case, one for one."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper()
        lower = (upper if len(upper) == 1 else c).lower()
        # the one character whose lower case is two, of which the first counts
        self[code] = lower if len(lower) == 1 else lower[0]
        return self[code]


_FOLD = _Fold()


class Finder:
    """Values in order of their turn; empty ones and repeats (but for case) never have one."""

    def __init__(self, values: list[str]):
        self.edges: list[tuple[bool, bool]] = []
        self.automaton = ahocorasick.Automaton()
        for k, value in enumerate(values):
            self.edges.append((bool(value and _EDGE.match(value[0])), bool(value and _EDGE.match(value[-1]))))
            folded = value.translate(_FOLD)
            if folded and folded not in self.automaton:
                self.automaton.add_word(folded, (k, len(folded)))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """start, end, number of the value, of all that is replaced, in order of the text."""
        if not text or not self.any:
            return []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (k, size) in self.automaton.iter(text.translate(_FOLD)):
            found[k].append((last + 1 - size, last + 1))
        if not found:
            return []
        starts, ends, at = [], [], 0
        for m in _HELD.finditer(text):
            starts.append(at)
            ends.append(m.start())
            at = m.end()
        starts.append(at)
        ends.append(len(text))
        out: list[tuple[int, int, int]] = []
        for k in sorted(found):
            before, after = self.edges[k]
            taken, free = [], 0
            for start, end in found[k]:
                g = bisect_right(starts, start) - 1
                # between pieces of no length the last one begins where the text goes on
                if start < free or g < 0 or end > ends[g]:
                    continue
                if before and start > starts[g] and _WORD.match(text[start - 1]):
                    continue
                if after and end < ends[g] and _WORD.match(text[end]):
                    continue
                taken.append((start, end))
                free = end
            for start, end in taken:
                g = bisect_right(starts, start) - 1
                starts[g : g + 1], ends[g : g + 1] = [starts[g], end], [start, ends[g]]
            out += [(start, end, k) for start, end in taken]
        return sorted(out)

    def pieces(self, text: str | None) -> list[tuple[str, str | None, int | None]] | None:
        """gap, match, number of the value, and the rest of the text at last; None where nothing is replaced."""
        spans = self.spans(text or "")
        if not spans:
            return None
        out, at = [], 0
        for start, end, k in spans:
            out.append((text[at:start], text[start:end], k))
            at = end
        return [*out, (text[at:], None, None)]
