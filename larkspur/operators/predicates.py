"""Predicates with two truth values: a comparison with null is false, and its negation true.

Where a comparison stands unnegated it is left bare, since a filter drops null
and false alike; so it still reaches the Parquet scan as a pushed filter. Only
below ``none_of`` is it closed with ``coalesce``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "starts with": lambda a, b: a.startswith(b),
    "matches": lambda a, b: a.rlike(b),
}


def _kind(t) -> str:
    if isinstance(t, bool | T.BooleanType):
        return "boolean"
    if isinstance(t, int | float | T.NumericType):
        return "number"
    return "text" if isinstance(t, str | T.StringType) else "other"


@dataclass(frozen=True)
class Compare:
    """``field`` is a column name or an expression; an unknown name is null."""

    field: str | Column
    op: str
    value: object

    def column(self, df: DataFrame, closed: bool = False) -> Column:
        kind = "other"
        if isinstance(self.field, Column):
            left = self.field
        elif self.field in df.columns:
            left, t = F.col(f"`{self.field}`"), df.schema[self.field].dataType
            if isinstance(t, T.ArrayType) and self.op in ("starts with", "matches"):
                left, t = F.array_join(F.transform(left, lambda x: x.cast("string")), ""), T.StringType()  # a list reads as one text
            kind = _kind(t)
        else:
            left = F.lit(None)
        if self.value is None:
            return left.isNull() if self.op == "=" else left.isNotNull() if self.op == "!=" else F.lit(False)
        if isinstance(self.value, bool) and kind == "number":
            out = _OPS[self.op](left, F.lit(int(self.value)))
        elif kind != "other" and not isinstance(self.value, Column) and _kind(self.value) not in (kind, "other"):
            out = left.isNotNull() if self.op == "!=" else F.lit(False)  # types that do not compare
        else:
            out = _OPS[self.op](left, self.value)
        return F.coalesce(out, F.lit(False)) if closed else out


@dataclass(frozen=True)
class Combined:
    op: str
    parts: tuple

    def column(self, df: DataFrame, closed: bool = False) -> Column:
        if self.op == "not":
            return ~self.parts[0].column(df, True)
        out = self.parts[0].column(df, closed)
        for p in self.parts[1:]:
            more = p.column(df, closed)
            out = (out & more) if self.op == "and" else (out | more)
        return out


def where(field: str | Column, op: str = "=", value: object = True) -> Compare:
    return Compare(field, op, value)


def all_of(*parts) -> Combined:
    return Combined("and", parts)


def any_of(*parts) -> Combined:
    return Combined("or", parts)


def none_of(*parts) -> Combined:
    return Combined("not", (Combined("or", parts),))


def variant(field: str, name: str, **payload) -> Combined | Compare:
    """An enum's variant, with equal payload values where they are given."""
    test = Compare(F.col(field)["_variant"] if payload else F.col(field), "=", name)
    return Combined("and", (test, *(Compare(F.col(field)[name][k], "=", v) for k, v in payload.items()))) if payload else test
