"""The filter language: "field:condition" parts, joined by commas or in a list, all of which must hold.

A condition is a value (equality, with the field's type), >v, <v, >=v, <=v, !=v, a~b (inclusive range), hamming(text,n)
(at most n differing characters) or ngram(text,s) (n-gram similarity of s at least). Values with a comma or colon
are written in double quotes. A part without a colon is an error.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countspark.functions.strings import hamming, ngram_similarity

_RANGE = re.compile(r'^("[^"]*"|[^~"]+)~("[^"]*"|[^~"]+)$')
_CALL = re.compile(r"^(hamming|ngram)\((.*),\s*([0-9.]+)\)$")
_AGGREGATE = re.compile(r"^(count|avg|sum|min|max)\((.*)\)$")
AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


class FilterError(ValueError):
    """A filter that can't be read."""


def parts(filters: str | list[str] | None) -> list[tuple[str, str]]:
    """(field, condition) for each part; commas inside quotes or parentheses don't part."""
    out: list[tuple[str, str]] = []
    for text in [filters] if isinstance(filters, str) else filters or []:
        depth, quoted, start = 0, False, 0
        cuts = []
        for i, c in enumerate(text):
            if c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    cuts.append(text[start:i])
                    start = i + 1
        if quoted or depth:
            raise FilterError(f"open quote or parenthesis: {text!r}")
        for part in [*cuts, text[start:]]:
            field, colon, condition = part.strip().partition(":")
            if not colon or not field or not condition:
                raise FilterError(f"not of the form field:condition: {part!r}")
            out.append((field.strip(), condition.strip()))
    return out


def _plain(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text


def _value(df: DataFrame, field: str, text: str) -> Column:
    kind = df.schema[field].dataType
    if isinstance(kind, T.NumericType):
        try:
            float(_plain(text))
        except ValueError:
            raise FilterError(f"{field} is a number, {text!r} isn't") from None
        kind = kind if isinstance(kind, T.FractionalType) or re.fullmatch(r"-?\d+", _plain(text)) else T.DoubleType()
    return F.lit(_plain(text)).cast(kind)


def condition(df: DataFrame, field: str, text: str) -> Column:
    if field not in df.columns:
        raise FilterError(f"no field {field!r}")
    c = F.col(field)
    if m := _CALL.match(text):
        if m[1] == "hamming":
            return F.coalesce(hamming(c.cast("string"), F.lit(_plain(m[2]))) <= int(m[3]), F.lit(False))
        return ngram_similarity(c.cast("string"), F.lit(_plain(m[2]))) >= float(m[3])
    for sign in (">=", "<=", "!=", ">", "<"):
        if text.startswith(sign):
            v = _value(df, field, text[len(sign) :].strip())
            return {">=": c >= v, "<=": c <= v, "!=": c != v, ">": c > v, "<": c < v}[sign]
    if (m := _RANGE.match(text)) and not (text[0] == text[-1] == '"' and text.count('"') == 2):
        return c.between(_value(df, field, m[1]), _value(df, field, m[2]))
    return c == _value(df, field, text)


def predicate(df: DataFrame, filters: str | list[str] | None) -> Column:
    return reduce(lambda a, b: a & b, (condition(df, *p) for p in parts(filters)), F.lit(True))


def aggregate_of(df: DataFrame, text: str) -> tuple[str, str, Column]:
    """(function, field, condition) of "field:function(range)"; an empty range has no condition."""
    found = parts(text)
    if len(found) != 1 or not (m := _AGGREGATE.match(found[0][1])):
        raise FilterError(f"not of the form field:function(range): {text!r}")
    field = found[0][0]
    return m[1], field, condition(df, field, m[2]) if m[2].strip() else F.lit(True)
