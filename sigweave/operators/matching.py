"""Pattern-level matching: which pattern of which rule holds on which capture.

One projection reads a capture and turns all that rules can ask about it into keys: the
grams of its texts, its status, icon hashes, runtime values, probes, and expressions that
hold. An equi-join with the keys of the pack leaves few pairs of capture and pattern, and
the condition of the pattern decides each pair while the capture is at hand. Texts stay
in the task that read them and are read once, whatever the pack holds; only rows that hit
leave the stage, as ``(capture_id, pid, detail, version, failed)``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.expressions import capture_values, try_column
from sigweave.functions.text import clip_with_mark, extract, let, lower_text
from sigweave.functions.versions import expand_column, group_numbers
from sigweave.operators.candidates import Unit, folded, gram_keys, rarest_gram
from sigweave.schema import PARTS
from sigweave.sources.captures import part_text
from sigweave.sources.pack import PatternRow, RulePack

DETAIL_CHARS = 120
ZERO_WIDTH = "(zero-width match)"

HIT_COLUMNS = ("capture_id", "pid", "detail", "version", "failed")
#: Pattern id of the row that stands for a capture as such.
MARKER = -1

# Kinds of keys: the parts of a capture come first, in order.
_STATUS, _ICON, _JS, _DOM, _HOLDS, _FAILS, _ALWAYS, _SELF = range(len(PARTS), len(PARTS) + 8)
_LOW = 0xFFFFFFFF


def _named(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _key(kind: int, code: int) -> int:
    return kind << 32 | code & _LOW


def _keys(kind: int, codes: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("bigint").bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(kind << 32)))


def _named_keys(kind: int, names: Column) -> Column:
    return _keys(kind, F.transform(names, lambda n: F.crc32(n.cast("binary"))))


def _wanted_groups(pack: RulePack) -> int:
    """Highest group a version template refers to; -1 without templates."""
    return max([n for v in pack.versions for n in group_numbers(v) if n < 100], default=-1)


def _units(patterns: list[PatternRow]) -> tuple[list[Unit], dict[int, int]]:
    """Distinct patterns, and the unit of each pattern id. An unknown part means the body;
    patterns that do not read a text are units of their own."""
    known: dict[tuple, Unit] = {}
    of: dict[int, int] = {}
    for p in patterns:
        part = p.part if p.part in PARTS else "body"
        key = (part, p.type, p.pattern) if p.type in ("word", "regex") else (p.pid,)
        if key not in known:
            known[key] = Unit(len(known), part, p.type, p.pattern, p.java, p.groups, p.lowered, p.literals)
        of[p.pid] = known[key].ix
    return list(known.values()), of


_INDEX = [("key", pa.int64()), ("unit", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("pattern", pa.string()), ("literal", pa.string()),
          ("before", pa.list_(pa.string())), ("java", pa.string()), ("groups", pa.int32()), ("name", pa.string()), ("broken", pa.bool_())]


def _index_rows(patterns: list[PatternRow], units: list[Unit], of: dict[int, int]) -> Iterable[tuple]:
    """A row for each key of each unit. Of the literals of an expression the first that a
    text holds counts, so that a text meets a unit once."""
    for u in units:
        if u.type not in ("word", "regex"):
            continue
        part = PARTS.index(u.part)
        literals = ((u.lowered,) if u.lowered else ()) if u.type == "word" else u.literals
        for n, literal in enumerate(literals or (None,)):
            gram = None if literal is None else rarest_gram(literal)
            key = _key(_ALWAYS, part) if gram is None else _key(part, gram)
            yield key, u.ix, u.type, part, u.pattern, literal, list(literals[:n]), u.java, u.groups, None, False
    for p in patterns:
        if p.type in ("status", "icon_hash"):
            keys, name = [_key(_STATUS if p.type == "status" else _ICON, p.number)], None
        elif p.type in ("js", "dom"):
            keys, name = [_key(_JS if p.type == "js" else _DOM, _named(p.key))], p.key
        elif p.type == "dsl":
            keys, name = [_key(_HOLDS, p.pid), _key(_FAILS, p.pid)], None
        else:
            continue
        for key in keys:
            yield key, of[p.pid], p.type, None, p.pattern, None, [], p.java, p.groups, name, p.type == "js" and p.number == 1
    yield _key(_SELF, 0), MARKER, "self", None, "", None, [], None, 0, None, False


def _tables(spark: SparkSession, pack: RulePack, patterns: list[PatternRow]) -> tuple[DataFrame, DataFrame]:
    """Keys with what decides them, and the rules' patterns behind each unit. A pack checks
    its size when it is made, so both may be broadcast."""
    made = pack._tables
    at = (spark.sparkContext.applicationId, "index", tuple(p.pid for p in patterns))
    if at not in made:
        units, of = _units(patterns)
        rows = list(_index_rows(patterns, units, of))
        index = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_INDEX)], names=[n for n, _ in _INDEX]))
        shared = [(of[p.pid], p.pid, p.version) for p in patterns] + [(MARKER, MARKER, "")]
        behind = spark.createDataFrame(pa.table(
            [pa.array([r[i] for r in shared], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["unit", "pid", "version"]))
        made[at] = (index, behind)
    index, behind = made[at]
    return F.broadcast(index), F.broadcast(behind)


def _outcome(value: Column, pid: int) -> Column:
    """Key of an expression that holds or fails; NULL for one that does not hold."""
    return let(value, lambda v: F.when(v.isNull(), F.lit(_key(_FAILS, pid))).when(v, F.lit(_key(_HOLDS, pid))))


def _asked(captures: DataFrame, patterns: list[PatternRow], marked: bool) -> DataFrame:
    """One row per capture: the texts and values conditions need, and its keys."""
    units, _ = _units(patterns)
    texts = [u for u in units if u.type in ("word", "regex")]
    parts = [p for p in PARTS if any(u.part == p for u in texts)]
    codes: dict[int, set[int]] = {}
    always = set()
    for u in texts:
        part = PARTS.index(u.part)
        for literal in (((u.lowered,) if u.lowered else ()) if u.type == "word" else u.literals) or (None,):
            gram = None if literal is None else rarest_gram(literal)
            if gram is None:
                always.add(part)
            else:
                codes.setdefault(part, set()).add(gram)
    rows = captures.select("*", *[part_text(p).alias(f"_text{PARTS.index(p)}") for p in parts])
    rows = rows.select("*", *[lower_text(F.col(f"_text{PARTS.index(p)}")).alias(f"_lower{PARTS.index(p)}") for p in parts])
    rows = rows.select("*", *[folded(F.col(f"_lower{PARTS.index(p)}")).alias(f"_folded{PARTS.index(p)}") for p in parts])
    kinds = {p.type for p in patterns}
    keys = []
    if codes:
        keys.append(gram_keys({k: F.col(f"_folded{k}") for k in codes}, codes))
    fixed = [F.lit(_key(_ALWAYS, part)).cast("bigint") for part in sorted(always)] + ([F.lit(_key(_SELF, 0)).cast("bigint")] if marked else [])
    if fixed:
        keys.append(F.array(*fixed))
    if "status" in kinds:
        keys.append(_keys(_STATUS, F.array(F.coalesce("status", F.lit(0)))))
    if "icon_hash" in kinds:
        keys.append(_keys(_ICON, F.coalesce(F.array_compact(F.array_distinct("favicon_hashes")), F.array().cast("array<int>"))))
    if "js" in kinds:
        keys.append(F.coalesce(_named_keys(_JS, F.map_keys("js")), F.array().cast("array<bigint>")))
    if "dom" in kinds:
        keys.append(F.coalesce(_named_keys(_DOM, F.map_keys(F.map_filter("dom_hits", lambda _k, v: v))), F.array().cast("array<bigint>")))
    if "dsl" in kinds:
        names = capture_values()
        told = [_outcome(try_column(p.pattern, names), p.pid) for p in patterns if p.type == "dsl"]
        keys.append(F.array_compact(F.array(*told)).cast("array<bigint>"))
    values = [c for c, kind in (("js", "js"), ("dom_hits", "dom")) if kind in kinds]
    held = [f"_{form}{PARTS.index(p)}" for p in parts for form in ("text", "lower", "folded")]
    return rows.select("capture_id", *values, *held, F.concat(*keys).alias("_keys"))


def _of_part(rows: DataFrame, form: str) -> Column:
    """The text of the part a pattern reads."""
    out = F.lit("")
    for n in range(len(PARTS)):
        if f"_{form}{n}" in rows.columns:
            out = F.when(F.col("part") == n, F.col(f"_{form}{n}")).otherwise(out)
    return out


def pattern_hits(captures: DataFrame, pack: RulePack, types: tuple[str, ...] | None = None, marked: bool = False) -> DataFrame:
    """All seven matcher types. With ``marked`` every capture has one more row, of the pattern
    id ``MARKER``."""
    patterns = [p for p in pack.patterns if p.valid and p.type and (types is None or p.type in types)]
    if not patterns and not marked:
        return captures.select("capture_id", F.lit(0).alias("pid"), F.lit("").alias("detail"),
                               F.lit("").alias("version"), F.lit(False).alias("failed")).where(F.lit(False))
    index, behind = _tables(captures.sparkSession, pack, patterns)
    asked = _asked(captures, patterns, marked)
    # The outer form, because for the inner one the optimizer adds a filter on the
    # array's size and would then make the keys twice.
    tried = asked.withColumn("key", F.explode_outer("_keys")).drop("_keys").join(index, "key")
    text, lower, plain = (_of_part(asked, form) for form in ("text", "lower", "folded"))
    kind, java = F.col("kind"), F.col("java")
    value = F.coalesce(F.element_at("js", F.col("name")), F.lit("")) if "js" in asked.columns else F.lit("")
    first = F.col("literal").isNull() | (F.contains(plain, F.col("literal")) & ~F.exists("before", lambda b: F.contains(plain, b)))
    holds = (
        F.when(kind == "word", F.col("literal").isNull() | F.contains(lower, F.col("literal")))
        .when(kind == "regex", first & F.rlike(text, java))
        .when(kind == "js", F.map_contains_key("js", F.col("name")) & (F.col("broken") | java.isNull() | F.rlike(value, java)) if "js" in asked.columns else F.lit(False))
        .when(kind == "dom", F.coalesce(F.try_element_at("dom_hits", F.col("name")), F.lit(False)) if "dom_hits" in asked.columns else F.lit(False))
        .otherwise(True))
    matched = let(extract(text, java, 0), lambda m: F.when(m == "", F.lit(ZERO_WIDTH)).otherwise(clip_with_mark(m, DETAIL_CHARS)))
    detail = (
        F.when(kind == "regex", matched).when(kind == "status", F.concat(F.lit("status "), F.col("pattern")))
        .when(kind == "icon_hash", F.concat(F.lit("mmh3 "), F.col("pattern")))
        .when(kind == "js", F.concat(F.lit("window."), F.col("name"), F.when(value != "", F.concat(F.lit(" = "), value)).otherwise("")))
        .otherwise(F.col("pattern")))
    wanted, subject = _wanted_groups(pack), F.when(kind == "js", value).otherwise(text)
    group = lambda n: F.when(F.col("groups") >= n, extract(subject, java, F.least(F.lit(n), F.col("groups")))).otherwise("")
    none = F.array().cast("array<string>")
    captured = F.when(java.isNotNull() & ~F.col("broken"), F.array(*[group(n) for n in range(wanted + 1)]).cast("array<string>")).otherwise(none) if wanted >= 0 else none
    failed = F.col("broken") | (F.shiftright("key", 32) == _FAILS)
    narrow = tried.where(holds).select("capture_id", "unit", detail.alias("detail"), captured.alias("captured"), failed.alias("failed"))
    version = expand_column(F.col("version"), F.col("captured"), pack.versions)
    return narrow.join(behind, "unit").select("capture_id", "pid", "detail", F.coalesce(version, F.lit("")).alias("version"), "failed")


def text_hits(captures: DataFrame, pack: RulePack) -> DataFrame:
    """Words and regular expressions over the parts of each capture."""
    return pattern_hits(captures, pack, ("word", "regex"))
