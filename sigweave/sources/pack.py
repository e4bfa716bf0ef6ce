"""A rule pack: rules compiled once, when they load, into small tables.

A pack is configuration. It is held on the driver, its size is checked here, and
every table made from it may therefore be broadcast. Page data never gets here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.expressions import is_readable
from sigweave.functions.hashing import FNV_OFFSET, FNV_PRIME
from sigweave.functions.patterns import compile_pattern

MAX_RULES = 100_000
MAX_PATTERNS = 1_000_000


class PackTooLarge(ValueError):
    """More rules than a pack may hold; split it and union the hits."""


def lower_literal(text: str) -> str:
    return text.replace("Σ", "σ").replace("İ", "i").lower()


def probe_key(sel: str, text: str = "", attrs: dict | None = None) -> str:
    pairs = "\x01".join(f"{k}={v}" for k, v in sorted((attrs or {}).items()))
    h = FNV_OFFSET
    for byte in f"{sel}\0{text}\0{pairs}".encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFF
    return f"dom:{h:08x}"


@dataclass(frozen=True)
class PatternRow:
    pid: int
    mid: int
    rule_ord: int
    matcher_ix: int
    pattern_ix: int
    type: str
    part: str
    pattern: str
    valid: bool
    java: str | None = None
    groups: int = 0
    version: str = ""
    literals: tuple = ()
    lowered: str = ""
    number: int | None = None
    key: str | None = None


@dataclass(frozen=True)
class MatcherRow:
    mid: int
    rule_ord: int
    matcher_ix: int
    type: str
    part: str
    condition: str
    negative: bool
    n_patterns: int
    n_invalid: int
    confidence: int | None


@dataclass(frozen=True)
class RuleRow:
    rule_ord: int
    rule_id: str
    name: str
    condition: str
    n_matchers: int
    confidence: int | None


def _confidence(value) -> int | None:
    return value if isinstance(value, int) and 0 <= value <= 100 else None


def _payload(m: dict) -> list[dict]:
    """Pattern facts of one matcher, in the order they are evaluated."""
    kind = m.get("type")
    out = []
    if kind == "word":
        for word in m.get("words") or []:
            low = lower_literal(word)
            out.append(dict(pattern=word, valid=True, lowered=low, literals=(low,) if low else ()))
    elif kind == "regex":
        for text in m.get("regex") or []:
            found = compile_pattern(text)
            out.append(dict(pattern=text, valid=found.valid, java=found.java, groups=found.groups, literals=found.literals))
    elif kind == "status":
        out = [dict(pattern=str(n), valid=True, number=n) for n in m.get("status") or []]
    elif kind == "icon_hash":
        out = [dict(pattern=str(n), valid=True, number=n) for n in m.get("hash") or []]
    elif kind == "dsl":
        out = [dict(pattern=e, valid=is_readable(e)) for e in m.get("dsl") or []]
    elif kind == "js":
        for probe in m.get("js") or []:
            text = probe.get("pattern") or ""
            found = compile_pattern(text, False)
            out.append(dict(pattern=text, valid=True, java=found.java if text else None,
                            groups=found.groups, key=probe.get("path") or "", number=0 if found.valid else 1))
    elif kind == "dom":
        for sel in m.get("words") or []:
            out.append(dict(pattern=sel, valid=True, key=probe_key(sel)))
        for probe in m.get("dom") or []:
            out.append(dict(pattern=probe.get("sel") or "", valid=True,
                            key=probe_key(probe.get("sel") or "", probe.get("text") or "", probe.get("attrs"))))
    else:
        out = [dict(pattern="", valid=False)]
    return out


@dataclass
class RulePack:
    """Compiled rules; lists for the planner side, DataFrames for the joins."""

    source: list[dict]
    rules: list[RuleRow] = field(default_factory=list)
    matchers: list[MatcherRow] = field(default_factory=list)
    patterns: list[PatternRow] = field(default_factory=list)
    _tables: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if len(self.source) > MAX_RULES:
            raise PackTooLarge(f"{len(self.source)} rules, at most {MAX_RULES} fit one pack")
        for rule_ord, rule in enumerate(self.source):
            matchers = rule.get("matchers") or []
            self.rules.append(RuleRow(
                rule_ord, rule["id"], rule.get("name") or rule["id"],
                "and" if rule.get("matchers-condition") == "and" else "or",
                len(matchers), _confidence(rule.get("confidence")),
            ))
            for matcher_ix, m in enumerate(matchers):
                self._add(rule_ord, matcher_ix, m)
        if len(self.patterns) > MAX_PATTERNS:
            raise PackTooLarge(f"{len(self.patterns)} patterns, at most {MAX_PATTERNS} fit one pack")

    def _add(self, rule_ord: int, matcher_ix: int, m: dict) -> None:
        mid, payload = len(self.matchers), _payload(m)
        kind, part = m.get("type") or "", m.get("part") or "body"
        self.matchers.append(MatcherRow(
            mid, rule_ord, matcher_ix, kind, part, "and" if m.get("condition") == "and" else "or",
            bool(m.get("negative")), len(payload), sum(not p["valid"] for p in payload), _confidence(m.get("confidence")),
        ))
        for pattern_ix, facts in enumerate(payload):
            self.patterns.append(PatternRow(
                len(self.patterns), mid, rule_ord, matcher_ix, pattern_ix, kind, part, version=m.get("version") or "", **facts
            ))

    @classmethod
    def from_file(cls, path: str | Path) -> RulePack:
        text = Path(path).read_text(encoding="utf-8")
        return cls.from_documents([json.loads(text)])

    @classmethod
    def from_documents(cls, docs: list) -> RulePack:
        flat = [r for doc in docs for r in (doc if isinstance(doc, list) else [doc])]
        return cls([r for r in flat if r.get("id") and r.get("matchers")])

    @classmethod
    def from_table(cls, rules: DataFrame, order: str = "rule_ord") -> RulePack:
        """Compile a table with a ``rule`` struct. Rules that can be used are counted before
        any is fetched; too many raise an error."""
        usable = rules.where((F.coalesce("rule.id", F.lit("")) != "") & (F.size("rule.matchers") > 0))
        if usable.limit(MAX_RULES + 1).count() > MAX_RULES:
            raise PackTooLarge(f"more than {MAX_RULES} rules, too many for one pack")
        rows = usable.orderBy(order).select(F.to_json("rule").alias("j")).collect()
        return cls.from_documents([json.loads(r["j"]) for r in rows])

    def of_type(self, *types: str) -> list[PatternRow]:
        return [p for p in self.patterns if p.type in types and p.valid]

    def only(self, *types: str) -> RulePack:
        """The same pack with matchers of other types removed."""
        kept = [{**r, "matchers": [m for m in r["matchers"] if m.get("type") in types]} for r in self.source]
        return RulePack([r for r in kept if r["matchers"]])

    @property
    def versions(self) -> set[str]:
        return {p.version for p in self.patterns if p.version}

    @property
    def negative_ids(self) -> list[int]:
        return [m.mid for m in self.matchers if m.negative]

    @cached_property
    def by_key(self) -> dict[str, RuleRow]:
        """Lower-case name or id to rule; the last rule to use a key has it."""
        out: dict[str, RuleRow] = {}
        for rule in self.rules:
            for key in (rule.name, rule.rule_id):
                if key:
                    out[key.lower()] = rule
        return out

    # Tables. Every one of them is bounded by the checks above.

    def pattern_table(self, spark: SparkSession, rows: list[PatternRow] | None = None, units: dict[int, int] | None = None) -> DataFrame:
        rows = self.patterns if rows is None else rows
        unit = [("unit", pa.int32(), [units[r.pid] for r in rows])] if units else []
        return self._table(spark, "patterns", rows, unit + [
            ("pid", pa.int32()), ("mid", pa.int32()), ("pattern_ix", pa.int32()), ("type", pa.string()),
            ("part", pa.string()), ("pattern", pa.string()), ("java", pa.string()), ("groups", pa.int32()),
            ("version", pa.string()), ("lowered", pa.string()), ("number", pa.int32()), ("key", pa.string()),
        ])

    def matcher_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "matchers", self.matchers, [
            ("mid", pa.int32()), ("rule_ord", pa.int32()), ("matcher_ix", pa.int32()), ("type", pa.string()),
            ("part", pa.string()), ("condition", pa.string()), ("negative", pa.bool_()),
            ("n_patterns", pa.int32()), ("n_invalid", pa.int32()), ("confidence", pa.int32()),
        ])

    def rule_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "rules", self.rules, [
            ("rule_ord", pa.int32()), ("rule_id", pa.string()), ("name", pa.string()),
            ("condition", pa.string()), ("n_matchers", pa.int32()), ("confidence", pa.int32()),
        ])

    def _table(self, spark: SparkSession, name: str, rows: list, fields: list[tuple]) -> DataFrame:
        """Small table from attributes of rows, or from values a field brings
        along; made once per application and selection of rows."""
        key = (spark.sparkContext.applicationId, name, tuple(f[0] for f in fields), tuple(getattr(r, "pid", 0) for r in rows))
        if key not in self._tables:
            columns = [pa.array(f[2] if len(f) > 2 else [getattr(r, f[0]) for r in rows], f[1]) for f in fields]
            self._tables[key] = spark.createDataFrame(pa.table(columns, names=[f[0] for f in fields]))
        return self._tables[key]


__all__ = ["PackTooLarge", "RulePack", "lower_literal", "probe_key"]
