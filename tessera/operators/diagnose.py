"""Looks a table over and recommends how to use its columns."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..sources.clients import Client
from . import advice, contracts, leakage, profile, routing, screening
from .key_lookup import column_name
from .predictor import Domain
from .profile import ColumnProfile, ColumnSpec

# Dollars up to which every row is sent, and the share sent otherwise.
ALL_ROWS_USD, SOME_ROWS = 2.0, 0.2


@dataclass(frozen=True)
class Diagnosis:
    n_rows: int
    task: str
    target: dict
    columns: list[ColumnProfile]
    duplicates: leakage.DuplicateReport
    text_duplicates: leakage.DuplicateReport | None
    screens: dict[str, dict]
    warnings: list[str]

    def by_kind(self, kind: str) -> list[str]:
        return [c.name for c in self.columns if c.kind == kind]

    def column(self, name: str) -> ColumnProfile:
        found = [c for c in self.columns if c.name == name]
        if not found:
            raise TesseraError(f"no such column: {name}")
        return found[0]

    def as_dict(self) -> dict:
        return json.loads(json.dumps(asdict(self), default=str))

    def __str__(self) -> str:
        lines = [f"{self.n_rows:,} rows, {self.task}"]
        lines += [f"  {c.name}: {c.kind}{f' ({c.note})' if c.note else ''}, {c.n_unique:,} values, {c.missing_rate:.1%} missing" for c in self.columns]
        lines += [str(self.duplicates), *(f"{k}: {v['verdict']} ({v['contribution']:+.1%})" for k, v in self.screens.items()), *(f"! {w}" for w in self.warnings)]
        return "\n".join(lines)


@dataclass(frozen=True)
class Recommendation:
    task: str
    target: str
    id_col: str
    spec: ColumnSpec
    target_transform: str | None = None
    clip_outliers: bool = False
    dedup_ignore: list[str] = field(default_factory=list)
    escalate_rate: float = 0.0
    reasons: list[str] = field(default_factory=list)
    source: str = "rules"
    diagnosis: Diagnosis | None = None
    unit: str = ""
    domain: Domain | None = None
    typed_columns: list[dict] = field(default_factory=list)
    knowledge_columns: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def to_code(self) -> str:
        """A script that carries the recommendation out."""
        name = "EvidenceRegressor" if self.task == "regression" else "EvidenceClassifier"
        lines = ["from pyspark.sql import functions as F", f"from tessera.operators.predictor import Domain, {name}", "from tessera.operators.profile import ColumnSpec, clip_and_log", "from tessera.operators.leakage import first_of_each", *(["from tessera.operators.key_lookup import KeyLookup"] if self.knowledge_columns else []), "", f"frame = first_of_each(frame, {self.id_col!r}, ignore={self.dedup_ignore!r})"]
        target = self.target
        if self.clip_outliers or self.target_transform == "log1p":
            lines.append(f"frame = clip_and_log(frame, {self.target!r})")
            target = "log_target" if self.target_transform == "log1p" else self.target
        s, numeric, categorical = self.spec, list(self.spec.numeric), list(self.spec.categorical)
        for k in self.knowledge_columns:
            # Needs a client, which the script's user passes in.
            column = k["name"] or column_name(k["attribute"])
            lines.append(f"frame = KeyLookup({k['keys']!r}, {k['attribute']!r}, {k['type']!r}, values={k['values']!r}, unit={k['unit']!r}, client=client, name={column!r}).fit(frame).transform(frame)")
            (numeric if k["type"] == "numeric" else categorical).append(column)
        for c in self.typed_columns:
            lines.append(f"# Worth typing: {c['name']} out of {c['source']} ({c['type']}: {', '.join(c['values'])}), see tessera.operators.typed_column")
        more = f", unit={self.unit!r}" if self.unit else ""
        if self.domain:
            more += f", domain=Domain({', '.join(f'{k}={v!r}' for k, v in asdict(self.domain).items())})"
        lines += [f"spec = ColumnSpec(numeric={numeric!r}, boolean={list(s.boolean)!r}, categorical={categorical!r}, text={s.text!r}, long_text={s.long_text!r})", f"model = {name}({target!r}, {self.id_col!r}, spec=spec, escalate_rate={self.escalate_rate!r}{more}).fit(frame.where({self.id_col!r} + ' % 5 <> 0'))", f"result = model.predict(frame.where({self.id_col!r} + ' % 5 = 0'))"]
        return "\n".join(lines)

    def __str__(self) -> str:
        return "\n".join([f"{self.task} of {self.target}: send {self.escalate_rate:.0%} of the rows", *(f"- {r}" for r in self.reasons), *(f"! {w}" for w in self.warnings)])


def run_diagnosis(frame: DataFrame, target: str, id_col: str, task: str | None = None, screen_text: bool = True, folds: int = 3, sample: int = 20_000) -> Diagnosis:
    if target not in frame.columns:
        raise TesseraError(f"no such column: {target}")
    task = task or profile.infer_task(frame, target)
    columns = profile.profile(frame, id_col)
    spec = profile.spec_of([c for c in columns if c.name != id_col], target)
    about = profile.number_target(frame, target).first().asDict() if task == "regression" else {str(r["label"]): r["n"] for r in profile.class_target(frame, target).collect()}
    warnings = []
    missing = frame.where(F.col(target).isNull()).count()
    if missing:
        warnings.append(f"{missing} rows have no {target}")
    if task == "classification" and about and min(about.values()) < profile.RARE * sum(about.values()):
        warnings.append("a class is rare")
    ignored = [c.name for c in columns if c.kind in ("id", "datetime", "constant")] + [id_col]
    kept = [c for c in frame.columns if c not in ignored]
    duplicates = leakage.check_duplicates(frame, keys=kept or None)
    if not duplicates.ok:
        warnings.append(str(duplicates))
    text = spec.long_text or spec.text
    repeats = leakage.check_duplicates(frame.where(F.trim(F.col(text)) != ""), keys=[text]) if text else None
    screens = {}
    for name in [n for n in (spec.text, spec.long_text) if n and screen_text]:
        row = screening.screen(frame, target, name, id_col, list(spec.numeric), list(spec.categorical), task, folds, sample).first()
        screens[name] = {k: row[k] for k in ("verdict", "contribution", "wins", "score_without", "score_with")}
    return Diagnosis(frame.count(), task, about, columns, duplicates, repeats, screens, warnings)


def recommend(found: Diagnosis, target: str, id_col: str) -> Recommendation:
    """By rules: external answers only where some text carries signal."""
    spec = profile.spec_of([c for c in found.columns if c.name != id_col], target)
    verdicts, cost = [s["verdict"] for s in found.screens.values()], found.n_rows * routing.COST_A_ROW
    if "worth_trying" in verdicts:
        rate, why = (1.0 if cost <= ALL_ROWS_USD else SOME_ROWS), "a text column carries signal"
    elif "inconclusive" in verdicts:
        rate, why = SOME_ROWS, "a text column may carry signal"
    else:
        rate, why = 0.0, "no text column was found to carry signal"
    about = found.target if found.task == "regression" else {}
    return Recommendation(found.task, target, id_col, spec, "log1p" if about.get("log_suggested") else None, bool(about.get("clip_suggested")), [c.name for c in found.columns if c.kind in ("id", "datetime", "constant")], rate, [why], "rules", found, warnings=list(found.warnings))


def question(rule: Recommendation) -> dict:
    """What an answerer is shown: the profile and the rules' draft, no row of the table."""
    found = rule.diagnosis
    draft = {"task": rule.task, **asdict(rule.spec), "target_transform": rule.target_transform or "none", "clip_outliers": rule.clip_outliers, "dedup_ignore": rule.dedup_ignore, "escalate_rate": rule.escalate_rate}
    names = [c.name for c in found.columns if c.name not in (rule.target, rule.id_col)]
    return {"kind": "diagnose", "table": str(found), "profile": found.as_dict(), "target": rule.target, "columns": names, "draft": draft, "schema": contracts.advised(names)}


def refined(rule: Recommendation, client: Client) -> Recommendation:
    """Asks the client to mend the rules' draft; what does not fit the profile is dropped with a warning, and a failed call changes nothing."""
    try:
        answer = client.ask(json.loads(json.dumps(question(rule), default=str)))
        if not isinstance(answer, Mapping):
            raise TypeError("no object")
    except Exception:  # an answerer's failure leaves the rules' answer
        return replace(rule, reasons=[*rule.reasons, "the external answerer failed"])
    found, notes = rule.diagnosis, []
    kinds = {c.name: c.kind for c in found.columns if c.name not in (rule.target, rule.id_col)}
    spec = advice.slots(answer, kinds, notes)
    if not spec.all_columns():
        return rule
    task = answer.get("task") if answer.get("task") in ("regression", "classification") else rule.task
    told = advice.reasons(answer.get("reasons"))
    if not told:
        notes.append("the answerer gave no reasons: hold its advice against the profile")
    numbers = task == "regression"
    return replace(
        rule,
        task=task,
        spec=spec,
        unit=advice.words_of(answer.get("unit")) or rule.unit,
        domain=advice.domain(answer, rule.target, [] if numbers else list(found.target)),
        target_transform=("log1p" if answer["target_transform"] == "log1p" else None) if numbers and "target_transform" in answer else rule.target_transform if numbers else None,
        clip_outliers=numbers and bool(answer.get("clip_outliers", rule.clip_outliers)),
        dedup_ignore=advice.columns(answer["dedup_ignore"], kinds | {rule.id_col: "id"}, "dedup_ignore", notes) if isinstance(answer.get("dedup_ignore"), list) else rule.dedup_ignore,
        typed_columns=advice.typed_columns(answer.get("typed_columns"), kinds, notes),
        knowledge_columns=advice.knowledge_columns(answer.get("knowledge_columns"), kinds, notes),
        escalate_rate=advice.share(answer.get("escalate_rate"), rule.escalate_rate),
        warnings=[*rule.warnings, *map(str, advice.listed(answer.get("warnings"))), *notes],
        reasons=[*rule.reasons, *told],
        source="llm",
    )


def diagnose(frame: DataFrame, target: str, id_col: str, task: str | None = None, llm: bool | str = "auto", client: Client | None = None, screen_text: bool = True, folds: int = 3, sample: int = 20_000) -> Recommendation:
    """Profile, checks, screens and a recommendation; ``llm`` True needs a client, "auto" uses one that is there."""
    if llm is True and (client is None or not client.available()):
        raise TesseraError("no external answerer is available")
    rule = recommend(run_diagnosis(frame, target, id_col, task, screen_text, folds, sample), target, id_col)
    return refined(rule, client) if llm and client is not None and client.available() else rule


