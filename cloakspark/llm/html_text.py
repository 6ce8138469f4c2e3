"""HTML extraction by wrappers inferred as union-free regular expressions.

A page is a stream of slots: one per block of text, known by the containers and the tag it stands in. Adjacent
repetitions in a stream fold into repeated groups `( ... )+`. Streams of one host are aligned one after the other with
the wrapper so far; where they differ, the differing stretch becomes optional, `( ... )?`. Alignment goes in rounds of
at most FAN streams to a task, so a host of very many layouts is no single group.

Then every page is matched against its host's wrapper, which tells its blocks apart by their place in the expression,
and what stands in each slot of the wrapper is summed over the host: whether its text varies, and whether it is marked
as an article. That makes a slot content or template (see `content_slots`). A page gives the blocks that match
content slots; containers that never hold an article (menus, footers, adverts ...) are in no stream.
"""

from __future__ import annotations

import difflib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakspark.llm._common import ascii_lower, checkpointed, map_batches, table

#: Wrappers up to this many bytes in all are broadcast; more are joined by host, with salt.
BROADCAST_BYTES = 32 << 20
SALTS = 16
SCHEMA = "page_id long, url string, text string, n_chars long"
#: Streams that one task aligns for a host.
FAN = 32
#: Nodes of a stream, and different slots of a page, beyond which they are generalised.
LONG, MANY = 256, 200

#: Elements whose content isn't markup or isn't shown.
_RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|select|canvas|title"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.I | re.S)
_CONTAINERS = frozenset("html body article main section div nav header footer aside form ul ol dl table tbody thead tr td th figure details dialog menu fieldset blockquote".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption caption summary address legend head".split())
_VOID = frozenset("br hr img meta link input source wbr area base col embed param track".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements and words in class, id or role that mark what isn't the article.
_NEVER = frozenset("nav footer aside form menu dialog button head".split())
_NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header masthead footer "
    "comment comments disqus reply replies notice cookie cookies consent popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager login search".split()
)
#: Words that may stand beside such a word in a name inside an article: any other word there makes it a name of the article's own.
_BESIDE = frozenset("area bar block box btn button buttons card col column container form group icon icons inline inner item items label link links list module outer panel row section signup slot strip thread tools top bottom left right unit wrap wrapper".split())
#: Names that inside an article are its own.
_OWN_INSIDE = frozenset("header masthead".split())
_ARTICLE = frozenset(("article", "main"))
_ARTICLE_WORDS = frozenset("article main content post entry story".split())
_SPACE = re.compile(r"\s+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_of(url: str | None) -> str:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without a ://."""
    _, sep, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].translate(_LOWER) if sep else ""


def marked_never(names: list[str], inside: bool) -> bool:
    """Whether names in class, id or role mark what isn't the article. Outside of an article any word of a name does; inside, all of its words must agree."""
    for name in names:
        words = [w for w in re.split(r"[_-]+", name) if w]
        never = [w for w in words if w in _NEVER_WORDS and not (inside and w in _OWN_INSIDE)]
        if never and not (inside and any(w not in _NEVER_WORDS and w not in _BESIDE and not w.isdigit() for w in words)):
            return True
    return False


class Element:
    """An open container: its key in paths, and whether it can hold the article."""

    __slots__ = ("key", "name", "never", "path", "within")

    def __init__(self, name: str, rest: str, parent: Element | None):
        names: list[str] = []
        if rest:
            for a in _ATTRIBUTE.finditer(rest):
                names += (a[2] or a[3] or a[4] or "").lower().split()
        words = [w for n in names for w in re.split(r"[_-]+", n)]
        self.name = name
        # marker words on the page's own roots tell of its layout; an article in an article may be a comment
        root = name in ("html", "body", "main") or (name == "article" and not (parent and parent.within))
        inside = bool(parent and parent.within)
        self.within = inside or name in _ARTICLE or not _ARTICLE_WORDS.isdisjoint(words)
        self.never = bool(parent and parent.never) or name in _NEVER or (not root and marked_never(names, inside)) or (name == "header" and not inside)
        marks = [w for w in words if w and not any(c.isdigit() for c in w)]
        self.key = ".".join([name, *marks[:3]])
        self.path = f"{parent.path}/{self.key}" if parent else self.key


def parsed(html: str) -> list[tuple[str, Element | None, str]]:
    """Blocks of a whole page in order: (block tag, container, text with one space for white space). Unclosed elements end with their parent."""
    open_: list[Element] = []
    blocks: list[tuple[str, Element | None, str]] = []
    text: list[str] = []
    tag = ""

    def flush() -> None:
        nonlocal text
        if text:
            if joined := _SPACE.sub(" ", entities.unescape("".join(text))).strip():
                blocks.append((tag, open_[-1] if open_ else None, joined))
            text = []

    for m in _TOKEN.finditer(html):
        if (t := m["text"]) is not None:
            text.append(t)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            text.append("\n")
        elif name in _BLOCKS:
            flush()
            if m["close"]:
                tag = ""
                if any(e.name == name for e in open_):
                    while open_.pop().name != name:
                        pass
            elif name in _CONTAINERS or name == "head":
                tag = name
                if name == "body":  # a head may be left open
                    while open_ and open_[-1].name != "html":
                        open_.pop()
                if not m["rest"].endswith("/"):
                    open_.append(Element(name, m["rest"], open_[-1] if open_ else None))
            else:
                tag = name
    flush()
    return blocks


# Wrappers: a node is a slot, or ("+", nodes) for a repeated group, or ("?", nodes) for an optional one.


def folded(nodes: list) -> list:
    """The nodes with adjacent repetitions as repeated groups, shortest first, until none is left."""
    out = nodes
    for size in (1, 2, 3, 4, 6):
        made, i = [], 0
        while i < len(out):
            unit, j = out[i : i + size], i + size
            while len(unit) == size and out[j : j + size] == unit:
                j += size
            if j > i + size:
                made.append(unit[0] if size == 1 and unit[0][0] == "+" else ("+", tuple(unit)))
                i = j
            else:
                made.append(out[i])
                i += 1
        out = made
    return out


def taken_apart(node) -> tuple[bool, bool, object]:
    """Whether a node is optional, whether it is repeated, and what is inside."""
    optional = repeated = False
    while isinstance(node, tuple) and len(node[1]) == 1:
        optional, repeated = optional or node[0] == "?", repeated or node[0] == "+"
        node = node[1][0]
    return optional, repeated, node


def put_together(optional: bool, repeated: bool, core):
    node = ("+", (core,)) if repeated else core
    return ("?", (node,)) if optional else node


def aligned(wrapper: list, stream: list) -> list:
    """The wrapper that also takes in `stream` (or another wrapper): what only one of them has becomes optional, what one of them repeats is repeated."""
    ours, theirs = [taken_apart(n) for n in wrapper], [taken_apart(n) for n in stream]
    out: list = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, [n[2] for n in ours], [n[2] for n in theirs], autojunk=False).get_opcodes():
        if op == "equal":
            out += [put_together(x[0] or y[0], x[1] or y[1], x[2]) for x, y in zip(ours[a:b], theirs[c:d], strict=True)]
        else:
            out += [put_together(True, r, core) for _, r, core in ours[a:b] + theirs[c:d]]
    return bounded(folded(out))


def bounded(nodes: list) -> list:
    """Nodes of a very long expression as one repeated group of all its slots, each optional, in order of appearance."""
    if len(nodes) <= LONG:
        return nodes
    return [("+", tuple([("?", (s,)) for s in dict.fromkeys(slots(nodes))]))]


def slots(nodes) -> Iterator[str]:
    """The slots of an expression in order; their number there is what the rest knows them by."""
    for n in nodes:
        if isinstance(n, str):
            yield n
        else:
            yield from slots(n[1])


def shown(nodes) -> str:
    """A wrapper or stream as text."""
    return " ".join([n if isinstance(n, str) else f"( {shown(n[1])} ){n[0]}" for n in nodes])


def read(text: str) -> list:
    """What `shown` wrote."""
    stack: list[list] = [[]]
    for t in text.split():
        if t == "(":
            stack.append([])
        elif t in (")+", ")?"):
            group = tuple(stack.pop())
            stack[-1].append((t[1], group))
        else:
            stack[-1].append(t)
    return stack[0]


def names_of(blocks: list) -> list[str]:
    """The slot of each block: its containers and its tag. Pages of very many different ones are read by the names of the two innermost containers."""
    names = [f"{e.path if e else '-'}>{tag or '-'}#" for tag, e, _ in blocks]
    if len(set(names)) > MANY:
        names = [f"{'/'.join([re.split(r'[.]', k)[0] for k in e.path.split('/')[-2:]]) if e else '-'}>{tag or '-'}#" for tag, e, _ in blocks]
    return names


def stream_of(blocks: list) -> list:
    """The folded stream of a page."""
    return bounded(folded(names_of(blocks)))


def wrapper_of(streams: list[str]) -> str:
    """The union-free expression that takes in all streams of a host, in sorted order."""
    whole: list | None = None
    for s in sorted(set(streams)):
        nodes = read(s)
        whole = nodes if whole is None else whole if whole == nodes else aligned(whole, nodes)
    return shown(whole or [])


class Matcher:
    """Matches pages against a wrapper: which slot of the expression each block stands in."""

    def __init__(self, wrapper: str):
        self.first: set[int] = set()
        self.follow: list[set[int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.known: dict[tuple[str, ...], list[int | None]] = {}
        _, first, last = self._built(read(wrapper))
        self.first, self.last = set(first), set(last)

    def _built(self, nodes) -> tuple[bool, list[int], list[int]]:
        """Whether nodes may be absent, and the slots they may begin and end with; fills in which slot may follow which."""
        absent, first, last = True, [], []
        for n in nodes:
            if isinstance(n, str):
                own = len(self.follow)
                self.follow.append(set())
                self.at[n].append(own)
                none, f, e = False, [own], [own]
            else:
                none, f, e = self._built(n[1])
                if n[0] == "+":
                    for x in e:
                        self.follow[x].update(f)
                none = none or n[0] == "?"
            for x in last:
                self.follow[x].update(f)
            first = first + f if absent else first
            last = last + e if none else e
            absent = absent and none
        return absent, first, last

    def __call__(self, names: list[str]) -> list[int | None]:
        """The number of the slot of each block, the leftmost way through the expression; None for a block that it can't take in."""
        key = tuple(names)
        if key not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[key] = self._matched(names)
        return self.known[key]

    def _matched(self, names: list[str]) -> list[int | None]:
        steps: list[dict[int, int]] = []
        reached = {-1}
        for name in names:
            step = {}
            for p in self.at.get(name, ()):
                before = [q for q in reached if p in (self.first if q < 0 else self.follow[q])]
                if before:
                    step[p] = min(before)
            steps.append(step)
            reached = set(step) or reached
        out: list[int | None] = [None] * len(names)
        state = min(reached & self.last, default=min(reached))
        for k in range(len(names) - 1, -1, -1):
            if steps[k]:
                out[k], state = state, steps[k][state]
        return out


def content_slots(found: list[tuple[int, set[int], bool, bool]]) -> list[int]:
    """Numbers of the slots that hold article text. found: slot, the slots in the same element with it, whether its text varies, whether it is marked as an article.

    Marked slots are content, whatever the number of pages. Of the others a slot whose text never varies is template,
    unless it stands in one element with a slot that varies; where none varies, nothing tells them apart and all are content.
    """
    varying = {s for s, _, varies, marked in found if varies and not marked}
    return sorted(s for s, near, varies, marked in found if marked or varies or not varying or not varying.isdisjoint(near))


def usable_blocks(html: str) -> list:
    """The blocks of a page that aren't in a container that never holds an article."""
    return [b for b in parsed(html) if not (b[1] and b[1].never)]


def article(blocks: list, places: list[int | None], content: set[int]) -> str:
    """The text of the blocks in content slots; of those in article elements only, where the page has any."""
    chosen = [(e, t) for (_, e, t), p in zip(blocks, places, strict=True) if p in content]
    return "\n".join([t for e, t in chosen if e and e.within] or [t for _, t in chosen])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: the inferred expression of every host. pages: host, html."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            streams = {(host, shown(stream_of(usable_blocks(page or "")))) for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)}
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(streams), strict=True)], ["host", "wrapper"])

        return each

    def infer(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [wrapper_of(rows["wrapper"].tolist())]})

    layouts = checkpointed(map_batches(pages.select("host", "html"), make, "host string, wrapper string").distinct())
    while True:
        sizes = layouts.groupBy("host").count()
        if not sizes.where(F.col("count") > FAN).limit(1).count():
            return layouts.groupBy("host").applyInPandas(infer, "host string, wrapper string")
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("count") / (FAN // 2)))
        layouts = checkpointed(layouts.join(sizes, "host").withColumn("part", part).groupBy("host", "part").applyInPandas(infer, "host string, wrapper string").distinct())


def by_host(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with what is known of their host: broadcast if it is small, else joined by host and salt."""
    size = known.agg(F.sum(sum([F.length(c) for c in known.columns], F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), "host", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", salts), ["host", "salt"], "left").drop("salt")


def slot_facts(pages: DataFrame) -> DataFrame:
    """host, slot, near (slots that stand in one element with it), n, low, high, marked: sums over all pages with blocks that match a slot. pages: host, html, wrapper."""

    def make():
        matchers: dict[str, Matcher] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            facts: dict[tuple[str, int], list] = {}
            for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                blocks = usable_blocks(page or "")
                matcher = matchers.get(wrapper) or matchers.setdefault(wrapper, Matcher(wrapper))
                own: dict[int, list] = {}
                inside: dict[int, set[int]] = defaultdict(set)
                for (_, e, text), slot in zip(blocks, matcher(names_of(blocks)), strict=True):
                    if slot is not None:
                        o = own.setdefault(slot, [set(), False, []])
                        o[1] = o[1] or bool(e and e.within)
                        o[2].append(text)
                        if e:
                            o[0].add(id(e))
                            inside[id(e)].add(slot)
                for slot, (elements, within, texts) in own.items():  # of a repeated group all texts of a page are one
                    h = xxhash.xxh64_intdigest("\n".join(texts)) >> 1
                    f = facts.setdefault((host, slot), [set(), 0, h, h, within])
                    f[0].update(*(inside[e] for e in elements))
                    f[1], f[2], f[3], f[4] = f[1] + 1, min(f[2], h), max(f[3], h), f[4] or within
            if not facts:
                return None
            columns = zip(*[(*k, sorted(v[0]), *v[1:]) for k, v in facts.items()], strict=True)
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "slot", "near", "n", "low", "high", "marked"])

        return each

    facts = map_batches(pages.select("host", "html", "wrapper"), make, "host string, slot int, near array<int>, n long, low long, high long, marked boolean")
    return facts.groupBy("host", "slot").agg(F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("marked").alias("marked"))


def decided(facts: DataFrame) -> DataFrame:
    """host, content: the numbers of the slots of each host that hold article text, comma-joined. A host has as many rows here as its wrapper has slots."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        found = [(int(s), set(near), bool(n == 1 or low != high), bool(m)) for s, near, n, low, high, m in rows[["slot", "near", "n", "low", "high", "marked"]].itertuples(index=False)]
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "content": [",".join(map(str, content_slots(found)))]})

    return facts.groupBy("host").applyInPandas(judge, "host string, content string")


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host."""
    pages = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    host = F.when(F.instr("url", "://") > 0, ascii_lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")
    return pages.withColumn("host", F.coalesce(host, F.lit("")))


def extracted_by(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page by the wrappers and content slots of hosts. pages: page_id, url, html, host; known: host, wrapper, content."""

    def make():
        matchers: dict[str, Matcher] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for page, wrapper, content in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "content")), strict=True):
                blocks = usable_blocks(page or "")
                matcher = matchers.get(wrapper or "") or matchers.setdefault(wrapper or "", Matcher(wrapper or ""))
                texts.append(article(blocks, matcher(names_of(blocks)), set(map(int, filter(None, (content or "").split(","))))))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    return map_batches(by_host(pages, known).select("page_id", "url", "html", "wrapper", "content"), make, SCHEMA)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html is empty and gives an empty text; a null url, or one without a host, belongs to the host "". Null ids and
    repeated rows pass through; other columns aren't read. On a host of a single page all usable blocks are content,
    or those in article elements.
    """
    pages = with_host(pages)
    inferred = checkpointed(wrappers(pages))
    content = decided(slot_facts(by_host(pages, inferred)))
    return extracted_by(pages, checkpointed(inferred.join(content, "host", "left")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html": op8_html}
ORACLES: dict[str, str] = {}
