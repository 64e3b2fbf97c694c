"""Arithmetic with explicit division, overflow and conversion rules, and exact numbers.

Integers of up to 64 bits stay in built-in expressions. Numbers beyond 38 digits
and exact fractions are decimal texts handled by Arrow-batched functions.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = "decimal(38,0)"


def limits(bits: int, signed: bool = True) -> tuple[int, int]:
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def true_div(a: Column, b: Column) -> Column:
    return a.cast("double") / b.cast("double")


def _floating(*columns: Column) -> Column:
    """Whether any of the columns is a float or double; known when the plan is analysed."""
    out = F.lit(False)
    for c in columns:
        out |= F.typeof(c).isin("float", "double")
    return out


def floor_div(a: Column, b: Column) -> Column:
    """Rounds toward minus infinity, where ``div`` truncates; division by zero is an error."""
    q = F.call_function("div", a.cast("long"), b.cast("long"))
    whole = q - F.when((a.cast("long") % b.cast("long") != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)
    return F.when(_floating(a, b), F.floor(a.cast("double") / b.cast("double"))).otherwise(whole)


def floor_mod(a: Column, b: Column) -> Column:
    """With the sign of the divisor, which neither % nor pmod gives for a negative one."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def overflow(value: Column, bits: int, policy: str = "error", signed: bool = True) -> Column:
    """Bring a wide integer into its type: ``saturating``, ``wrapping`` or an error."""
    lo, hi = limits(bits, signed)
    wide = value.cast(_WIDE)
    low, high = F.lit(str(lo)).cast(_WIDE), F.lit(str(hi)).cast(_WIDE)
    kind = "long" if hi < 1 << 63 else "decimal(20,0)"
    if policy == "saturating":
        out = F.greatest(F.least(wide, high), low)
    elif policy == "wrapping":
        size = F.lit(str(1 << bits)).cast(_WIDE)
        off = wide - low
        out = off - F.floor(off / size).cast(_WIDE) * size + low
    else:
        out = F.when(wide.between(low, high), wide).when(wide.isNotNull(), F.raise_error(F.lit(f"value out of range for {bits} bits")))
    return out.cast(kind)


def add(a: Column, b: Column, bits: int, policy: str = "error", signed: bool = True) -> Column:
    return overflow(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"), bits, policy, signed)


def subtract(a: Column, b: Column, bits: int, policy: str = "error", signed: bool = True) -> Column:
    return overflow(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"), bits, policy, signed)


def multiply(a: Column, b: Column, bits: int, policy: str = "error", signed: bool = True) -> Column:
    if signed or bits < 64:
        return overflow(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), bits, policy, signed)
    # products of unsigned 64-bit numbers pass 38 digits, so the upper half of one factor goes first
    x, y, half = a.cast("decimal(20,0)"), b.cast("decimal(20,0)"), F.lit(str(1 << 32)).cast("decimal(11,0)")
    high, low = F.floor(x / half).cast("decimal(11,0)"), (x % half).cast("decimal(11,0)")
    upper, lower = (high * y).cast("decimal(31,0)"), (low * y).cast("decimal(31,0)")
    if policy == "wrapping":
        return overflow((upper % half).cast("decimal(11,0)") * half + lower, bits, policy, signed)
    # an upper part of 2^32 or more is out of range whatever the rest is
    return overflow(F.least(upper, half.cast("decimal(31,0)")).cast("decimal(11,0)") * half + lower, bits, policy, signed)


def convert(value: Column, bits: int, signed: bool = True) -> Column:
    """To an integer type: an error for fractions and for values out of range."""
    whole = F.when(value.isNull() | (F.floor(value) == value), value).otherwise(F.raise_error(F.lit("not a whole number")))
    return overflow(whole, bits, "error", signed)


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def square_root(x: Column) -> Column:
    """An error below zero, where the built-in gives NaN."""
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(x))


def logarithm(x: Column) -> Column:
    """Natural; an error at and below zero, where the built-in gives null."""
    return F.when(x <= 0, F.raise_error(F.lit("logarithm of a number that is not positive")).cast("double")).otherwise(F.log(x))


def number_range(start, stop=None, step: int = 1) -> Column:
    """start, start + step, ... before stop; empty where there are none."""
    lo, hi = (F.lit(0), start) if stop is None else (start, stop)
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    last = hi - 1 if step > 0 else hi + 1
    return F.when((lo < hi) if step > 0 else (lo > hi), F.sequence(lo, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


@F.pandas_udf(T.FloatType())
def half(x: pd.Series) -> pd.Series:
    """The nearest 16-bit float."""
    with np.errstate(over="ignore"):
        return x.astype(np.float16).astype(np.float32)


def _exact(op):
    return lambda a, b: pd.Series([None if x is None or y is None else str(op(int(x), int(y))) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def big_add(a: pd.Series, b: pd.Series) -> pd.Series:
    return _exact(int.__add__)(a, b)


@F.pandas_udf(T.StringType())
def big_subtract(a: pd.Series, b: pd.Series) -> pd.Series:
    return _exact(int.__sub__)(a, b)


@F.pandas_udf(T.StringType())
def big_multiply(a: pd.Series, b: pd.Series) -> pd.Series:
    return _exact(int.__mul__)(a, b)


@F.pandas_udf(T.StringType())
def big_floor_div(a: pd.Series, b: pd.Series) -> pd.Series:
    return _exact(int.__floordiv__)(a, b)


@F.pandas_udf(T.StringType())
def big_mod(a: pd.Series, b: pd.Series) -> pd.Series:
    return _exact(int.__mod__)(a, b)


@F.pandas_udf(T.IntegerType())
def big_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    """-1, 0 or 1."""
    return pd.Series([None if x is None or y is None else (int(x) > int(y)) - (int(x) < int(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


_FRACTION = T.StructType().add("num", "string").add("den", "string")


def _fractions(op, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """A fraction with a null part, and what is made of one, has two null parts."""
    rows = zip(a.num, a.den, b.num, b.den, strict=True)
    out = [None if any(x is None for x in row) else op(Fraction(int(row[0]), int(row[1])), Fraction(int(row[2]), int(row[3]))) for row in rows]
    return pd.DataFrame({k: pd.Series([None if x is None else str(getattr(x, name)) for x in out], dtype=object) for k, name in (("num", "numerator"), ("den", "denominator"))})


@F.pandas_udf(_FRACTION)
def fraction_add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return _fractions(Fraction.__add__, a, b)


@F.pandas_udf(_FRACTION)
def fraction_subtract(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return _fractions(Fraction.__sub__, a, b)


@F.pandas_udf(_FRACTION)
def fraction_multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return _fractions(Fraction.__mul__, a, b)


@F.pandas_udf(_FRACTION)
def fraction_divide(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    return _fractions(Fraction.__truediv__, a, b)


def fraction(num: Column, den: Column) -> Column:
    return F.struct(num.cast("string").alias("num"), den.cast("string").alias("den"))


def elementwise(a: Column, b: Column, op, a_list: bool = False, b_list: bool = False) -> Column:
    """Lists of one length element by element, or a list with one value."""
    if a_list and b_list:
        same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("lists differ in length")).cast("boolean")).otherwise(True)
        return F.when(same, F.zip_with(a, b, op))
    if a_list:
        return F.transform(a, lambda x: op(x, b))
    return F.transform(b, lambda x: op(a, x)) if b_list else op(a, b)


def _start(known: Column, value: int) -> Column:
    """What a fold over a list begins with: a wide integer for integers, a double for floats."""
    return F.get(known, F.lit(0)) * 0 + F.lit(value).cast(_WIDE)


def list_sum(a: Column) -> Column:
    """Of a list's values, nulls left out; null for an empty list."""
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, _start(known, 0), lambda t, x: t + x))


def list_average(a: Column) -> Column:
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.size(known))


def list_product(a: Column) -> Column:
    known = F.filter(a, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, _start(known, 1), lambda t, x: t * x))


def boolean(x: Column) -> Column:
    """Numbers are true unless zero."""
    return x != 0


def enum_name(discriminant: Column, variants: dict[str, int]) -> Column:
    """The variant with a discriminant; an error for an unknown one."""
    table = F.create_map(*[F.lit(v) for k, d in variants.items() for v in (d, k)])
    name = F.try_element_at(table, discriminant)
    return F.when(discriminant.isNull() | name.isNotNull(), name).otherwise(F.raise_error(F.lit("no variant has this discriminant")))


def enum_value(name: Column, variants: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(v) for k, d in variants.items() for v in (k, d)])
    value = F.try_element_at(table, name)
    return F.when(name.isNull() | value.isNotNull(), value).otherwise(F.raise_error(F.lit("no such variant")))


def uuid() -> Column:
    return F.uuid()
