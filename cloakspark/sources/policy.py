"""Policy and run configuration: load, check, hash; what a policy means for masking; environment over file over default."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any

_ON = frozenset(("1", "true", "yes", "on"))


def lenient_bool(raw: str | None, default: bool = False) -> bool:
    """1, true, yes and on are true; nothing given is the default."""
    return default if raw is None else raw.strip().lower() in _ON


def at(document: Any, path: str) -> Any:
    """What stands at a dotted path of nested objects, None for nothing."""
    return reduce(lambda d, key: d.get(key) if isinstance(d, dict) else None, path.split("."), document)


def _labelled(entries: Any) -> bool:
    return isinstance(entries, list) and all(at(e, "field") and at(e, "label") for e in entries)


@dataclass(frozen=True)
class Rule:
    """What must hold at a path of the policy (or its lifecycle, under `lifecycle`)."""

    path: str
    holds: Callable[[Any], bool]
    says: str


_OBJECT, _LIST_IF_ANY = (lambda x: isinstance(x, dict)), (lambda x: x is None or isinstance(x, list))
RULES = (
    *(Rule(section, _OBJECT, "must be an object") for section in ("structured", "unstructured")),
    *(Rule(f"structured.{name}", _labelled, "must list fields with labels") for name in ("static_fields", "dynamic_fields")),
    Rule("unstructured.regex_patterns", _OBJECT, "must be an object of patterns by label"),
    *(Rule(f"unstructured.{name}", _LIST_IF_ANY, "must be a list") for name in ("name_context_patterns", "contextual_entity_patterns")),
    *(Rule(f"lifecycle.{name}", lambda x: x is not None, "is missing") for name in ("policy_id", "version", "runtime_flags")),
    Rule("lifecycle.status", lambda x: x == "active", "must be active"),
    Rule("lifecycle.mapping_storage.mode", lambda x: x in ("local", "db", "both"), "must be local, db or both"),
    Rule("lifecycle.mapping_security.encryption_provider", lambda x: x in (None, "vault", "none"), "must be vault or none"),
)


def faults(policy: dict[str, Any], lifecycle: dict[str, Any], rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All that is wrong with a policy and its lifecycle."""
    whole = {**policy, "lifecycle": lifecycle}
    return [f"{r.path} {r.says}" for r in rules if not r.holds(at(whole, r.path))]


def in_context(pattern: str, group: str) -> tuple[str, str, str]:
    """What stands before a named group of a pattern, the group, and what stands after it; other groups lose their names."""
    head, mark, rest = pattern.partition(f"(?P<{group}>")
    if not mark:
        raise ValueError(f"no group {group} in {pattern}")
    depth = 1
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|[()]", rest):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return tuple(re.sub(r"\(\?P<\w+>", "(?:", x) for x in (head, rest[: m.start()], rest[m.end() :]))
    raise ValueError(f"unclosed group {group} in {pattern}")


def _ignores_case(entry: dict[str, Any]) -> bool:
    return "IGNORECASE" in (entry.get("flags") or [])


@dataclass(frozen=True)
class Policy:
    """A checked policy with its identity, and its rules in the form that the masking operators take."""

    policy: dict[str, Any]
    lifecycle: dict[str, Any]

    def __post_init__(self) -> None:
        if wrong := faults(self.policy, self.lifecycle):
            raise ValueError("; ".join(wrong))

    @property
    def static_fields(self) -> tuple[tuple[str, str], ...]:
        return tuple((e["field"], e["label"]) for e in at(self.policy, "structured.static_fields"))

    @property
    def note_fields(self) -> tuple[str, ...]:
        return tuple(e["field"] for e in at(self.policy, "structured.dynamic_fields"))

    @property
    def note_patterns(self) -> tuple[tuple[str, str], ...]:
        return tuple((e["label"], e["pattern"]) for e in at(self.policy, "structured.deterministic_free_text_patterns") or [])

    @property
    def note_residuals(self) -> tuple[tuple[str, str, bool], ...]:
        """name, pattern with the value as group 1, ignoring case."""
        entries = at(self.policy, "structured.contextual_validation_patterns") or []
        parts = [(e, in_context(e["pattern"], e.get("group", "value"))) for e in entries]
        return tuple((e["label"].lower(), f"{b}({v}){a}", _ignores_case(e)) for e, (b, v, a) in parts)

    @property
    def aliases(self) -> dict[str, str]:
        return dict(at(self.policy, "structured.llm_category_aliases") or {})

    @property
    def text_patterns(self) -> tuple[tuple[str, str], ...]:
        return tuple(at(self.policy, "unstructured.regex_patterns").items())

    @property
    def name_contexts(self) -> tuple[tuple[str, str, str, bool], ...]:
        return tuple((*in_context(e["pattern"], e.get("group", "name")), _ignores_case(e)) for e in at(self.policy, "unstructured.name_context_patterns") or [])

    @property
    def entity_contexts(self) -> tuple[tuple[str, str, str, str, bool], ...]:
        return tuple((e["label"], *in_context(e["pattern"], e.get("group", "value")), _ignores_case(e)) for e in at(self.policy, "unstructured.contextual_entity_patterns") or [])

    @property
    def digest(self) -> str:
        """sha256 over both as JSON with sorted keys and no spaces."""
        whole = {"privacy_policy": self.policy, "policy_lifecycle": self.lifecycle}
        return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def metadata(self, run_id: str) -> dict[str, str]:
        """What every artifact of a run is marked with."""
        return {"run_id": run_id, "policy_id": str(self.lifecycle["policy_id"]), "policy_version": str(self.lifecycle["version"]), "policy_hash": self.digest}

    @classmethod
    def load(cls, policy_path: str, lifecycle_path: str) -> Policy:
        """From two JSON files."""
        return cls(*(json_object(p) for p in (policy_path, lifecycle_path)))


def json_object(path: str) -> dict[str, Any]:
    """The object in a JSON file; a missing, broken or other file is an error that names it."""
    try:
        value = json.loads(open(path, encoding="utf-8").read())
    except (OSError, ValueError) as e:
        raise type(e)(f"{path}: {e}") if isinstance(e, OSError) else ValueError(f"{path}: {e}") from e
    if isinstance(value, dict):
        return value
    raise ValueError(f"{path} must hold an object")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run, with their defaults."""

    provider: str = "http"
    detector_url: str = ""
    batch_size: int = 25
    max_characters: int = 12_000
    recovery_batch_size: int = 10
    delay_seconds: float = 0.5
    request_format: str = "openai_chat"
    response_format: str = "openai_chat"
    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 2000
    max_rehydration_passes: int = 5
    external_mode: str = "sftp_share"
    large_input_rows: int = 1000
    on_large_input: str = "file_drop"
    handoff_root: str = "handoff"
    wait_for_result: bool = True
    poll_seconds: float = 2.0
    timeout_seconds: float = 3600.0
    mapping_mode: str = "local"
    encrypt_mapping: bool = False
    mapping_key_id: str = ""
    anchor_ledger: bool = False
    anchor_provider: str = "mock"
    provenance: bool = True
    metrics: bool = True

    @classmethod
    def load(cls, file: dict[str, Any] | None = None, env: dict[str, str] | None = None, prefix: str = "CLOAKSPARK_") -> RunConfig:
        """Each setting from the environment (prefix and upper-case name), else from the file (by its own name or the place in FILE_PLACES), else the default."""
        env, file = os.environ if env is None else env, file or {}
        values: dict[str, Any] = {}
        for f in fields(cls):
            places = [env.get(prefix + f.name.upper()), file.get(f.name), at(file, FILE_PLACES.get(f.name, f.name))]
            raw = next((x for x in places if x is not None and not isinstance(x, dict)), None)
            if raw is not None:
                kind = type(f.default)
                values[f.name] = lenient_bool(str(raw)) if kind is bool else kind(raw)
        values["max_rehydration_passes"] = max(1, values.get("max_rehydration_passes", cls.max_rehydration_passes))
        return cls(**values)


#: Where settings stand in a nested configuration file.
FILE_PLACES = {
    "external_mode": "external_processing.mode", "large_input_rows": "external_processing.lambda_max_rows_without_override", "on_large_input": "external_processing.on_large_input", "handoff_root": "external_processing.handoff_root",
    "wait_for_result": "external_processing.wait_for_result", "poll_seconds": "external_processing.poll_interval_seconds", "timeout_seconds": "external_processing.result_timeout_seconds", "mapping_mode": "mapping_store.mode",
    "max_rehydration_passes": "rehydration.max_passes", "provenance": "runtime_flags.enable_provenance", "metrics": "runtime_flags.enable_performance_metrics",
}
