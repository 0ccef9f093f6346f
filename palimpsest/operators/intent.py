"""The boundary to a language model, and frozen intents: small records on the driver, strict or refused."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from palimpsest.operators.planning import INTENT_FIELDS

REQUIRED = ("object_terms", "task_terms", "method_terms", "scope_terms")
# What is asked about a field that is missing, in Chinese and English.
QUESTIONS = {
    "OBJECT": ("研究对象具体是什么？", "What is the exact research object?"),
    "TASK": ("希望完成什么研究任务？", "What research task should the papers support?"),
    "METHOD": ("方法是必需、偏好还是开放？", "Is the method required, preferred, or open?"),
    "SCOPE": ("适用范围或场景是什么？", "What application scope or setting is required?"),
    "ACCEPTED_PAPER_ROLES": ("可接受哪些论文角色？", "Which paper roles are acceptable?"),
    "EXCLUSIONS": ("有哪些需要排除的方向？", "Which directions should be excluded?"),
}


class IntentError(ValueError):
    """A candidate or draft that cannot be used as it is; nothing is repaired."""


@dataclass(frozen=True)
class Draft:
    object_terms: tuple[str, ...] = ()
    task_terms: tuple[str, ...] = ()
    method_terms: tuple[str, ...] = ()
    scope_terms: tuple[str, ...] = ()
    accepted_paper_roles: frozenset[str] = frozenset()
    exclusions: tuple[str, ...] = ()
    language: str = "en"
    confidence: dict = field(default_factory=dict)


def read_candidate(answer: dict) -> Draft:
    """A model's answer as a draft: known keys only, lists of non-blank strings, confidences within 0 and 1."""
    known = set(Draft.__dataclass_fields__)
    if not isinstance(answer, dict) or set(answer) - known:
        raise IntentError("UNKNOWN_FIELDS")
    for name in (*REQUIRED, "accepted_paper_roles", "exclusions"):
        terms = answer.get(name, [])
        if not isinstance(terms, (list, tuple)) or not all(isinstance(t, str) and t.strip() for t in terms) or len({t.strip().casefold() for t in terms}) < len(terms):
            raise IntentError("INVALID_TERMS")
    sure = answer.get("confidence", {})
    if not all(k in INTENT_FIELDS and isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1 for k, v in sure.items()):
        raise IntentError("INVALID_CONFIDENCE")
    if answer.get("language", "en") not in ("zh", "en", "mixed"):
        raise IntentError("INVALID_LANGUAGE")
    lists = {n: tuple(answer.get(n, ())) for n in (*REQUIRED, "exclusions")}
    return Draft(**lists, accepted_paper_roles=frozenset(answer.get("accepted_paper_roles", ())), language=answer.get("language", "en"), confidence=dict(sure))


def open_fields(draft: Draft) -> list[tuple[str, bool, float]]:
    """(field, missing, priority) of all but the exclusions, most urgent first; a field that is given has priority 0."""
    held = {"OBJECT": draft.object_terms, "TASK": draft.task_terms, "METHOD": draft.method_terms, "SCOPE": draft.scope_terms, "ACCEPTED_PAPER_ROLES": draft.accepted_paper_roles}
    rows = [(f, not v, 0.0 if v else 0.65 + 0.35 * (1 - draft.confidence.get(f, 0.5))) for f, v in held.items()]
    return sorted(rows, key=lambda r: (-r[2], INTENT_FIELDS.index(r[0])))


def clarifications(draft: Draft, most: int = 3) -> list[tuple[str, str]]:
    """(field, question) for the most urgent missing fields, in the language of the draft."""
    return [(f, QUESTIONS[f][draft.language != "zh"]) for f, missing, _ in open_fields(draft) if missing][:most]


def freeze(draft: Draft, at: datetime) -> dict:
    """The intent that planning may rely on; every required field must be there and the time be UTC."""
    if at.tzinfo is None or at.utcoffset() != UTC.utcoffset(None):
        raise IntentError("TIME_NOT_UTC")
    if any(not getattr(draft, f) for f in REQUIRED) or not draft.accepted_paper_roles:
        raise IntentError("INTENT_INCOMPLETE")
    out = asdict(draft)
    del out["confidence"]
    return {k: list(v) if isinstance(v, tuple) else sorted(v) if isinstance(v, frozenset) else v for k, v in out.items()} | {"frozen_at": at.isoformat(timespec="microseconds").replace("+00:00", "Z")}


def canonical_bytes(intent: dict) -> bytes:
    return json.dumps(intent, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def replayed(derived: dict, frozen: dict) -> dict:
    """The frozen intent, if the question still gives the very same one."""
    if canonical_bytes(derived) != canonical_bytes(frozen):
        raise IntentError("INTENT_REPLAY_MISMATCH")
    return frozen


def prepare(question: str, provider, at: datetime) -> tuple[str, object]:
    """("FROZEN", intent) or ("CLARIFY", questions) after exactly one call of provider(question) -> answer."""
    draft = read_candidate(provider(question))
    asked = clarifications(draft)
    return ("CLARIFY", asked) if asked else ("FROZEN", freeze(draft, at))


def stable_id(prefix: str, *parts) -> str:
    """Short identifier of a list of values, the same in every run."""
    return f"{prefix}-{hashlib.sha256(json.dumps(parts, separators=(',', ':')).encode()).hexdigest()[:16]}"
