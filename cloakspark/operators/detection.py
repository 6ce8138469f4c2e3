"""Contextual detection by a pluggable detector: batches go to it as prompts, its replies come back as rows.

Prompts are built from the rows of a batch inside a task, which also retries and splits; the JSON objects of the replies
are parsed, canonicalised, accepted and applied by DataFrame functions.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators.numbering import greedy_batches
from cloakspark.operators.records import applied_detections, objects_in, scattered, values_of_objects
from cloakspark.operators.reports import contextual_rows
from cloakspark.sources.policy import RunConfig
from cloakspark.sources.session import checkpointed, with_package

#: Takes a prompt, gives the text of the reply. It runs on the executors and must be picklable.
Detector = Callable[[str], str]

TASK = "List every personal or person-linked value in the records as a JSON object: category names as keys, arrays of exact snippets as values."
RECOVERY_TASK = TASK + " These records were searched before and still hold values: look again for names standing alone, standalone aliases, references and workplaces."
SYSTEM = "You find personal data and answer with JSON only."
RETRY_STATUS = (408, 409, 429)

# The names of formats, and where their replies hold the text.
CHAT, PLAIN = ("openai_chat", "azure_openai_chat"), ("prompt", "text")
REPLY_PATHS = {
    "openai_chat": [("choices", 0, "message", "content")], "azure_openai_chat": [("choices", 0, "message", "content")],
    "text": [(), ("text",), ("content",), ("response",), ("output",)], "raw_text": [(), ("text",), ("content",), ("response",), ("output",)],
}


def prompt(rows: list[dict[str, Any]], task: str = TASK) -> str:
    """The prompt of a batch."""
    return json.dumps({"task": task, "records": rows}, ensure_ascii=False)


def note_rows(key: str, columns: list[str]) -> Column:
    """A row of note fields for a prompt: blank cells and cells that are one placeholder are left out."""
    fields = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in columns]))
    return F.struct(F.col(key).cast("long").alias("row"), F.map_filter(fields, lambda c, v: v.isNotNull() & ~T.is_blank(v) & ~T.is_token(v)).alias("fields"))


def record_rows(number: str, text: str) -> Column:
    """A numbered record for a prompt, white space at its end cut."""
    return F.struct(F.col(number).cast("long").alias("record_number"), F.rtrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n")).alias("text"))


def request_body(user: str, config: RunConfig, system: str = SYSTEM) -> dict[str, Any]:
    """What is posted for a prompt, in the configured format."""
    if config.request_format not in CHAT + PLAIN:
        raise ValueError(f"unknown request format {config.request_format}")
    said = {"messages": [{"role": r, "content": c} for r, c in (("system", system), ("user", user))]} if config.request_format in CHAT else {"prompt": f"{system}\n\n{user}"}
    settings = {"model": config.model or None, "temperature": config.temperature, "max_tokens": config.max_tokens}
    return said | {k: v for k, v in settings.items() if v is not None}


def reply_text(payload: Any, form: str) -> str:
    """The text of a reply: the first of its format's places that holds one; a reply in JSON format is the text itself."""
    if form == "json":
        return json.dumps(payload)
    if form not in REPLY_PATHS:
        raise ValueError(f"unknown response format {form}")
    for path in REPLY_PATHS[form]:
        here = payload
        for step in path:
            fits = isinstance(here, list) and step == 0 and here if isinstance(step, int) else isinstance(here, dict) and step in here
            here = here[step] if fits else None
        if here is not None and not (path == () and not isinstance(here, str)):
            return str(here)
    raise ValueError(f"the reply holds no text in format {form}")


@dataclass(frozen=True)
class HttpDetector:
    """A detector behind an endpoint that takes and gives JSON."""

    url: str
    config: RunConfig
    headers: tuple[tuple[str, str], ...] = ()
    timeout: float = 120.0

    def __call__(self, said: str) -> str:
        body = json.dumps(request_body(said, self.config)).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **dict(self.headers)})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return reply_text(json.load(reply), self.config.response_format)


def dictionary_detector(values: dict[str, list[str]]) -> Detector:
    """A detector for tests and offline use: it finds the given values in the prompt."""
    return lambda said: json.dumps({c: [v for v in vs if v in said] for c, vs in values.items()})


#: Detectors by name of their provider; each takes the run configuration.
PROVIDERS: dict[str, Callable[[RunConfig], Detector]] = {name: (lambda c: HttpDetector(c.detector_url, c)) for name in ("http", "rest", "endpoint", "openai", "azure_openai", "custom")}


def detector_of(config: RunConfig) -> Detector:
    """The configured detector; an unknown provider is an error, as is one without an address."""
    if config.provider.lower() not in PROVIDERS or not config.detector_url:
        raise ValueError(f"no detector for provider {config.provider!r} at {config.detector_url!r}")
    return PROVIDERS[config.provider.lower()](config)


def transient(error: Exception) -> bool:
    """Whether a call may be tried again after a wait."""
    status = getattr(error, "code", None) or getattr(getattr(error, "response", None), "status_code", None)
    return isinstance(error, (TimeoutError, ConnectionError)) or (isinstance(status, int) and (status in RETRY_STATUS or status >= 500))


def called(detector: Detector, said: str, attempts: int = 3, wait: float = 5.0, malformed_again: bool = True, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """The JSON objects of the reply to a prompt. A malformed reply is asked for again at once (or not), a transient error after a growing wait."""
    for left in range(attempts - 1, -1, -1):
        try:
            return objects_in(detector(said))
        except Exception as e:
            malformed = isinstance(e, ValueError)
            if not left or (malformed and not malformed_again) or not (malformed or transient(e)):
                raise
            if not malformed:
                sleep(wait + random.uniform(0.5, 2.0))
                wait = min(wait * 2, 30.0)
    raise AssertionError


def bisected(detector: Detector, rows: list[dict[str, Any]], task: str = TASK, **how) -> Iterator[str]:
    """The JSON objects of all replies; rows whose reply is malformed are split in halves until it isn't. One that stays malformed alone is an error."""
    pending = [rows]
    while pending:
        part = pending.pop()
        try:
            yield from called(detector, prompt(part, task), malformed_again=False, **how)
        except ValueError:
            if len(part) <= 1:
                raise
            pending += [part[len(part) // 2 :], part[: len(part) // 2]]


def detected(rows: DataFrame, batch: str, order: str, item: Column, detector: Detector, task: str = TASK, split: bool = True, delay: float = 0.0, tasks: int | None = None) -> DataFrame:
    """batch, ord, category, value of all that the detector names; one call per batch of rows (a batch is at most the batch size).

    item: the row in the prompt, in order of the column `order`. A malformed reply splits the batch, or else is asked for
    again. A task waits `delay` seconds, and up to half a second more, between calls. The result is kept, so that a
    detector is never called a second time for the same batch. `tasks`, if given, deals the batches out over that many
    tasks: by their few bytes they would be gathered in one.
    """
    kind = dict(rows.dtypes)[batch]

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = 0
        for part in parts:
            out = []
            for b, items in zip(part["batch"], part["rows"], strict=True):
                if calls and delay > 0:
                    time.sleep(delay + random.uniform(0.0, 0.5))
                calls += 1
                said = [json.loads(i) for i in items]
                out.append((b, list(bisected(detector, said, task)) if split else called(detector, prompt(said, task))))
            yield pd.DataFrame(out, columns=["batch", "objects"])

    with_package(rows.sparkSession)
    dealt = rows.repartition(tasks, batch) if tasks else rows
    batches = dealt.groupBy(F.col(batch).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.to_json(item).alias("j")))), lambda x: x["j"]).alias("rows"))
    replies = checkpointed(batches.mapInPandas(ask, f"batch {kind}, objects array<string>"))
    return values_of_objects(replies, ["batch"], "objects").withColumnRenamed("batch", batch)


def numbered_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """The frame with `batch_id` by a dense row number (as `numbering.numbered` makes it)."""
    return df.withColumn("batch_id", F.floor(F.col(key) / size).cast("long"))


def packed_batches(df: DataFrame, group: str | None, key: str, text: str, size: int, characters: int) -> DataFrame:
    """The frame with `batch_id`: in each group (or all rows) records are packed in order of `key` until a batch is full or would grow too long."""
    by = F.lit("") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    sized, others = df.withColumns({"__group": by, "__size": F.length(text)}), [c for c in df.columns if c != key]
    batches = greedy_batches(sized, "__group", key, "__size", size, characters, also=others)
    return batches.select(key, *[f"`{c}`" for c in others], F.concat("batch", F.lit(" "), "__group").alias("batch_id"))


#: Records that a task sends to the detector, and replaces values in.
RECORDS_A_TASK = 10_000


def tasks_for(df: DataFrame) -> int:
    """As many tasks as the number of records asks for. df is kept."""
    n = df.count()
    return max(1, -(-n // RECORDS_A_TASK), min(n, df.sparkSession.sparkContext.defaultParallelism))


def two_phases(
    rows: DataFrame, key: str, text: str, run_id: str, detector: Detector, residual: Callable[[DataFrame], DataFrame], config: RunConfig | None = None, group: str | None = None, applied: str | None = None
) -> DataFrame:
    """Records of texts: detection and replacement on all rows, then again on the rows that `residual` still names.

    group and key (or key alone) tell a record; records are packed in order of `key` within their group, by number and by
    characters, in both phases. residual(rows) gives a frame with the same columns for the records that still hold
    something. Aliases and rules are those of plain text. `applied` names a further column, if given: the detections
    that replaced something in the record, of both phases.
    """
    config = config or RunConfig()
    keys, did = [k for k in (group, key) if k], applied or "__applied"

    def phase(df: DataFrame, task: str) -> DataFrame:
        tasks, batched = tasks_for(df), checkpointed(packed_batches(df, group, key, text, config.batch_size, config.max_characters))
        found = detected(batched, "batch_id", key, record_rows(key, text), detector, task, delay=config.delay_seconds, tasks=tasks)
        return checkpointed(applied_detections(batched, found, "batch_id", text, run_id, P.TEXT_ALIASES, notes=False, applied=did, tasks=tasks).drop("batch_id"))

    first = phase(checkpointed(rows), TASK)  # packing reads the rows several times
    left = checkpointed(first.join(residual(first.drop(did)).select(*keys).distinct(), keys, "left_semi").drop(did))
    if not left.isEmpty():
        again = phase(left, RECOVERY_TASK).select(*keys, F.col(text).alias("__new"), F.col(did).alias("__more"))
        both = F.array_distinct(F.concat(did, F.coalesce("__more", F.array().cast("array<struct<category:string,value:string>>"))))
        first = first.join(again, keys, "left").withColumns({text: F.coalesce("__new", text), did: both}).drop("__new", "__more")
    return first if applied else first.drop(did)


def note_phases(rows: DataFrame, key: str, columns: list[str], run_id: str, detector: Detector, config: RunConfig | None = None, aliases: dict[str, str] = P.NOTE_ALIASES) -> DataFrame:
    """Notes: detection over the note fields of all rows, values of a batch replaced in all its note fields, then again on rows that contextual detectors still name, in smaller batches."""
    config = config or RunConfig()
    columns = [c for c in columns if c in rows.columns]
    if not columns:
        return rows

    def phase(df: DataFrame, size: int, task: str) -> DataFrame:
        batched = numbered_batches(df, key, size)
        found = detected(batched, "batch_id", key, note_rows(key, columns), detector, task, split=False, delay=config.delay_seconds)
        return checkpointed(applied_detections(batched, found, "batch_id", columns, run_id, aliases).drop("batch_id"))

    first = phase(rows, config.batch_size, TASK)
    left = checkpointed(first.join(contextual_rows(first, key, columns), key, "left_semi"))
    if left.isEmpty():
        return first
    again = phase(left, min(config.recovery_batch_size, config.batch_size), RECOVERY_TASK)
    for c in columns:
        first = scattered(first, again, key, c)
    return first
