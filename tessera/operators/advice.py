"""An answerer's advice on a table, held against the table's profile: what cannot be carried out is left out and named.

Each function takes a part of the answer and returns what is usable; ``notes`` collects a line for each thing left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from .contracts import KINDS
from .predictor import Domain
from .profile import ColumnSpec

# Kinds of columns that can be keys of a lookup, and the most hints.
KEY_KINDS, MOST_HINTS = ("numeric", "boolean", "categorical", "text"), 3
#: The kinds that fit a slot.
FITTING = {"numeric": {"numeric", "boolean"}, "boolean": {"boolean"}, "categorical": {"categorical", "text", "boolean", "numeric"}, "text": {"text", "categorical"}, "long_text": {"text", "long_text"}}


def listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else []


def records(value) -> list[Mapping]:
    return [x for x in listed(value) if isinstance(x, Mapping)]


def words_of(value) -> str:
    return "" if value is None else str(value).strip()


def bare_role(role) -> str:
    """The role without the sentence around it: no "you are" before it and no stop after it."""
    said = re.sub(r"(?i)^you(?:\s+are|'re)\s*", "", words_of(role))
    return said.rstrip(".!").strip() or Domain.role


def columns(names: Iterable, kinds: Mapping[str, str], slot: str, notes: list[str]) -> list[str]:
    """The known ones, once each."""
    out = dict.fromkeys(str(n) for n in names if n not in (None, ""))
    strange = [n for n in out if n not in kinds]
    if strange:
        notes.append(f"{slot}: no such column as {', '.join(strange)}")
    return [n for n in out if n in kinds]


def slots(answer: Mapping, kinds: Mapping[str, str], notes: list[str]) -> ColumnSpec:
    """A column goes to the first slot that names it and that its kind fits; one called boolean that is none is categorical."""
    asked = {s: columns(listed(answer.get(s)), kinds, s, notes) for s in ("numeric", "boolean", "categorical")}
    asked |= {s: columns([answer.get(s)], kinds, s, notes) for s in ("text", "long_text")}
    moved = [n for n in asked["boolean"] if kinds[n] != "boolean"]
    if moved:
        notes.append(f"not boolean, so categorical: {', '.join(moved)}")
    asked["boolean"] = [n for n in asked["boolean"] if n not in moved]
    asked["categorical"] += [n for n in moved if n not in asked["categorical"]]
    placed: dict[str, str] = {}
    for slot, names in asked.items():
        unfit = [n for n in names if n not in placed and kinds[n] not in FITTING[slot]]
        if unfit:
            notes.append(f"{slot}: cannot take {', '.join(f'{n} ({kinds[n]})' for n in unfit)}")
        placed |= {n: slot for n in names if n not in placed and n not in unfit}
    held = {slot: [n for n in placed if placed[n] == slot] for slot in asked}
    return ColumnSpec(held["numeric"], held["boolean"], held["categorical"], *(held[s][0] if held[s] else None for s in ("text", "long_text")))


def typed_columns(items, kinds: Mapping[str, str], notes: list[str]) -> list[dict]:
    """Columns to be typed out of a known source."""
    out = []
    for x in records(items):
        if x.get("source") in kinds:
            out.append({"name": words_of(x.get("name")), "source": x["source"], "type": x.get("type") if x.get("type") in KINDS[:2] else "category", "values": [str(v) for v in listed(x.get("values"))], "why": words_of(x.get("why"))})
        else:
            notes.append(f"typed column {words_of(x.get('name')) or '?'}: no such source as {x.get('source')}")
    return out


def knowledge_columns(items, kinds: Mapping[str, str], notes: list[str]) -> list[dict]:
    """Lookups that can be run: an attribute, keys of a fitting kind, and values where the answer is one of a set.

    A binary one that has other than two values is a category; a numeric one has none.
    """
    out = []
    for x in records(items):
        keys, attribute, values = [str(k) for k in listed(x.get("keys"))], words_of(x.get("attribute")), list(dict.fromkeys(str(v) for v in listed(x.get("values"))))
        kind = x.get("type") if x.get("type") in KINDS else "category"
        name = words_of(x.get("name"))
        if kind == "binary" and len(values) != 2:
            kind = "category"
        unusable = [k for k in keys if kinds.get(k) not in KEY_KINDS]
        if not attribute or not keys or unusable:
            notes.append(f"lookup {name or attribute or '?'}: {'unusable keys ' + ', '.join(unusable) if unusable else 'no keys' if not keys else 'no attribute'}")
        elif kind == "category" and len(values) < 2:
            notes.append(f"lookup {name or attribute}: fewer than two values")
        else:
            out.append({"name": name, "keys": keys, "attribute": attribute, "type": kind, "values": [] if kind == "numeric" else values, "unit": words_of(x.get("unit")), "why": words_of(x.get("why"))})
    return out


def domain(answer: Mapping, target: str, classes: Sequence[str]) -> Domain:
    """The words of the question; meanings are kept for labels that the target has."""
    meanings = {words_of(x.get("label")): words_of(x.get("meaning")) for x in records(answer.get("class_names"))}
    return Domain(
        role=bare_role(answer.get("role")),
        subject=words_of(answer.get("subject")) or Domain.subject,
        target_name=words_of(answer.get("target_name")) or target,
        hints=tuple(map(str, listed(answer.get("hints"))[:MOST_HINTS])),
        class_names={c: meanings[c] for c in classes if meanings.get(c)},
    )


def reasons(items) -> list[str]:
    """Lines, out of lines or of (topic, reason)."""
    told = [f"{words_of(x.get('topic'))}: {words_of(x.get('reason'))}" if isinstance(x, Mapping) else words_of(x) for x in listed(items)]
    return [t for t in told if t.strip(": ")]


def share(value, otherwise: float) -> float:
    """A rate between 0 and 1."""
    try:
        given = float(value)
    except (TypeError, ValueError):
        return otherwise
    return otherwise if given != given else min(1.0, max(0.0, given))
