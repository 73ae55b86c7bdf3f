"""What answers must look like: the JSON schemas that go with questions."""

from __future__ import annotations

from collections.abc import Sequence

TEXT, NUMBER, FLAG, SHARE = {"type": "string"}, {"type": "number"}, {"type": "boolean"}, {"type": "number", "minimum": 0, "maximum": 1}
KINDS = ("category", "binary", "numeric")


def one_of(values: Sequence[str]) -> dict:
    return {"type": "string", "enum": list(dict.fromkeys(values))}


def many(item: dict) -> dict:
    return {"type": "array", "items": item}


def record(**fields: dict) -> dict:
    """An object with these fields, all of them and no others."""
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def settled(candidates: Sequence[str]) -> dict:
    """A stage's answer for one text."""
    return record(value=one_of(candidates), confidence=SHARE, reason=TEXT)


def looked_up(kind: str) -> dict:
    """The answers for a batch of keys; ``known`` is false where the answerer does not know."""
    return record(answers=many(record(key=TEXT, known=FLAG, value=NUMBER if kind == "numeric" else TEXT, confidence=SHARE, reason=TEXT)))


def proposed(columns: Sequence[str], most: int) -> dict:
    """Columns worth looking up, by keys among the table's."""
    column = record(name=TEXT, attribute=TEXT, kind=one_of(KINDS), keys=many(one_of(columns)), values=many(TEXT), unit=TEXT, range=many(NUMBER))
    return record(columns=many(column) | {"maxItems": most})


def advised(columns: Sequence[str]) -> dict:
    """Advice on a table: the words of the question, a slot for each column, and what may be added."""
    name = one_of(columns)
    names, maybe = many(name), {"anyOf": [name, {"type": "null"}]}
    slots = {"numeric": names, "boolean": names, "categorical": names, "text": maybe, "long_text": maybe}
    words = {"target_name": TEXT, "unit": TEXT, "role": TEXT, "subject": TEXT, "hints": many(TEXT), "class_names": many(record(label=TEXT, meaning=TEXT))}
    added = {
        "typed_columns": many(record(name=TEXT, source=name, type=one_of(KINDS[:2]), values=many(TEXT), why=TEXT)),
        "knowledge_columns": many(record(name=TEXT, keys=names, attribute=TEXT, type=one_of(KINDS), values=many(TEXT), unit=TEXT, why=TEXT)),
    }
    steps = {"target_transform": one_of(["none", "log1p"]), "clip_outliers": FLAG, "dedup_ignore": names, "escalate_rate": SHARE}
    return record(task=one_of(["regression", "classification"]), **words, **slots, **steps, **added, warnings=many(TEXT), reasons=many(record(topic=TEXT, reason=TEXT)))
