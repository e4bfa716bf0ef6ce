"""Boolean expressions of rules, loaded as Spark Columns.

The text of an expression such as ``contains(body,"x") && status == 200`` is
spelled as a Python expression, read by the standard ``ast`` module, and turned
into one nullable boolean Column: true, false, or NULL for an error. ``and`` and
``or`` are ``CASE`` chains because the order matters: an error on the left counts
even where the right side would decide, and one that is never reached does not.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from sigweave.functions.patterns import compile_pattern
from sigweave.functions.text import map_text

_LEXEMES = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||==|!=|!|[(),])
      |(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
      |(?P<number>-?[0-9]+)
      |(?P<name>[^\W\d]\w*))""",
    re.X | re.S,
)
_SPELLING = {"&&": " and ", "||": " or ", "!": " not "}
_ESCAPED = {"n": "\n", "t": "\t", '"': '"', "'": "'", "\\": "\\"}
INT64 = range(-(1 << 63), 1 << 63)


class ExpressionError(ValueError):
    """The text cannot be read as an expression."""


@dataclass(frozen=True)
class Value:
    """A typed Column: kind is ``str``, ``int`` or ``bool``."""

    kind: str
    column: Column
    literal: str | None = None


def capture_values() -> dict[str, Value]:
    """What the identifiers stand for, over a captures DataFrame."""
    text = lambda c: F.coalesce(c, F.lit(""))
    header = map_text(F.col("headers"))
    status = F.coalesce(F.col("status"), F.lit(0)).cast("bigint")
    return {
        "body": Value("str", text(F.col("body"))),
        "title": Value("str", text(F.col("title"))),
        "url": Value("str", text(F.col("url"))),
        "header": Value("str", header),
        "raw": Value("str", F.concat(header, text(F.col("body")))),
        "meta": Value("str", map_text(F.col("meta"))),
        "script": Value("str", text(F.array_join(F.col("scripts"), "\n"))),
        "status": Value("int", status),
        "status_code": Value("int", status),
        "favicon_hash": Value("int", F.coalesce(F.try_element_at("favicon_hashes", F.lit(1)), F.lit(0)).cast("bigint")),
        "true": Value("bool", F.lit(True)),
        "false": Value("bool", F.lit(False)),
    }


def _unescape(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m.group(1), m.group(0)), quoted[1:-1], flags=re.S)


def _spell(text: str) -> str:
    """The expression in Python spelling; names get a prefix, so none is special."""
    out, at, previous = [], 0, None
    while text[at:].strip(" \t\r\n"):
        m = _LEXEMES.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at + 1}")
        kind, token = m.lastgroup, m.group(m.lastgroup)
        if kind == "op":
            if token == ")" and previous == ",":
                raise ExpressionError("an argument is missing")
            out.append(_SPELLING.get(token, token))
        else:
            if previous in ("text", "number", "name"):
                raise ExpressionError("an operator is missing")
            if kind == "text":
                out.append(repr(_unescape(token)))
            else:
                out.append(f" ({int(token)}) " if kind == "number" else f" v_{token} ")
        previous = token if kind == "op" else kind
        at = m.end()
    return "".join(out).strip()


def java_pattern(pattern: Column) -> Column:
    """Java form of patterns that only exist as data; NULL when invalid."""

    @pandas_udf("string")
    def translate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda p: compile_pattern(p, False).java)

    return translate(pattern)


def _error(kind: str = "bool") -> Value:
    return Value(kind, F.lit(None).cast("bigint" if kind == "int" else "boolean"))


def _as_text(v: Value) -> Column:
    return v.column if v.kind == "str" else v.column.cast("string")


def _as_bool(v: Value) -> Column:
    if v.kind == "str":
        return v.column != ""
    return v.column != 0 if v.kind == "int" else v.column


def _matches(text: Value, pattern: Value) -> Column:
    if pattern.literal is not None:
        found = compile_pattern(pattern.literal, False)
        return F.rlike(_as_text(text), F.lit(found.java)) if found.valid else F.lit(None).cast("boolean")
    return F.rlike(_as_text(text), java_pattern(_as_text(pattern)))


def _call(node: ast.Call, names: dict[str, Value]) -> Value:
    args = [_value(a, names) for a in node.args]
    if len(args) != 2:
        return _error()
    failed = F.lit(False)
    for a in args:
        failed = failed | a.column.isNull()
    function = node.func.id[2:]
    if function == "contains":
        out = F.contains(_as_text(args[0]), _as_text(args[1]))
    elif function == "matches":
        out = _matches(args[0], args[1])
    else:
        return _error()
    return Value("bool", F.when(~failed, out))


def _value(node: ast.AST, names: dict[str, Value]) -> Value:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return Value("str", F.lit(node.value), node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        node = ast.Constant(-node.operand.value)
    if isinstance(node, ast.Constant) and isinstance(node.value, int):
        if node.value not in INT64:
            return _error("int")
        return Value("int", F.lit(node.value).cast("bigint"), str(node.value))
    if isinstance(node, ast.Name):
        return names.get(node.id[2:], _error())
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return Value("bool", ~_as_bool(_value(node.operand, names)))
    if isinstance(node, ast.BoolOp):
        decided = isinstance(node.op, ast.Or)
        parts = [_as_bool(_value(v, names)) for v in node.values]
        out = parts[-1]
        for part in reversed(parts[:-1]):
            out = F.when(part.isNull(), F.lit(None)).when(part == decided, F.lit(decided)).otherwise(out)
        return Value("bool", out)
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], (ast.Eq, ast.NotEq)):
        a, b = _value(node.left, names), _value(node.comparators[0], names)
        same = a.column == b.column if a.kind == b.kind == "int" else _as_text(a) == _as_text(b)
        return Value("bool", same if isinstance(node.ops[0], ast.Eq) else ~same)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return _call(node, names)
    raise ExpressionError("not an expression")


def to_column(text: str, names: dict[str, Value] | None = None) -> Column:
    """Nullable boolean Column for one expression; raises if it cannot be read."""
    spelled = _spell(text)
    try:
        tree = ast.parse(spelled, mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as err:
        raise ExpressionError(str(err)) from None
    return _as_bool(_value(tree, capture_values() if names is None else names))


def try_column(text: str, names: dict[str, Value] | None = None) -> Column:
    """Like ``to_column``, with NULL (an error on every row) for bad text."""
    try:
        return to_column(text, names)
    except ExpressionError:
        return F.lit(None).cast("boolean")


def is_readable(text: str) -> bool:
    """Whether the text has the shape of an expression at all."""
    try:
        ast.parse(_spell(text), mode="eval")
        return True
    except (ExpressionError, SyntaxError, ValueError):
        return False
