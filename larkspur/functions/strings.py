"""String functions with 0-based places. A null string gives null, but for length, is_empty and contains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def length(s: Column) -> Column:
    return F.coalesce(F.length(s), F.lit(0))


def is_empty(s: Column) -> Column:
    return F.coalesce(F.length(s) == 0, F.lit(True))


def contains(s: Column, x) -> Column:
    return F.coalesce(F.contains(s, _lit(x)), F.lit(False))


def uppercase(s: Column) -> Column:
    return F.upper(s)


def lowercase(s: Column) -> Column:
    return F.lower(s)


def capitalize(s: Column) -> Column:
    """First character upper, all others lower; not word by word."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def trim(s: Column) -> Column:
    """All Unicode white space, not blanks alone."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def starts_with(s: Column, x) -> Column:
    return F.startswith(s, _lit(x))


def ends_with(s: Column, x) -> Column:
    return F.endswith(s, _lit(x))


def index_of(s: Column, x: str) -> Column:
    return F.locate(x, s) - 1


def last_index_of(s: Column, x: str) -> Column:
    at = F.locate(x[::-1], F.reverse(s))
    return F.when(s.isNotNull(), F.when(at > 0, F.length(s) - (at - 1) - len(x)).otherwise(-1))


def pad_start(s: Column, n: int, c: str = " ") -> Column:
    """Never cuts the string, as lpad alone would."""
    return F.when(F.length(s) < n, F.lpad(s, n, c)).otherwise(s)


def pad_end(s: Column, n: int, c: str = " ") -> Column:
    return F.when(F.length(s) < n, F.rpad(s, n, c)).otherwise(s)


def repeat(s: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("repeat count must not be negative")
    return F.repeat(s, n)


def split(s: Column, delimiter: str) -> Column:
    """By a literal delimiter; trailing empty parts stay."""
    return F.split(s, r"\Q" + delimiter + r"\E", -1)


def match(s: Column, pattern: str) -> Column:
    """The whole match and its groups, or null without one."""
    groups = re.compile(pattern).groups
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, i) for i in range(groups + 1)]))


def replace_first(s: Column, old: str, new: str) -> Column:
    at = F.locate(old, s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


def replace_all(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def sort(s: Column) -> Column:
    return F.array_join(F.array_sort(F.split(s, "")), "")


def reverse(s: Column) -> Column:
    return F.reverse(s)


def at(s: Column, i: int) -> Column:
    """One character, from the end if negative; null beyond the string."""
    place = F.lit(i + 1) if i >= 0 else F.length(s) + i + 1
    return F.when((place >= 1) & (place <= F.length(s)), F.substring(s, place, F.lit(1)))


def cut(s: Column, start: int | None = None, stop: int | None = None) -> Column:
    """s[start:stop] with negative bounds counted from the end."""
    n = F.length(s)
    lo, hi = bounds(n, start, stop)
    return F.substring(s, lo + 1, F.greatest(hi - lo, F.lit(0)))


def bounds(n: Column, start: int | None, stop: int | None) -> tuple[Column, Column]:
    """Start and stop within 0..n."""

    def place(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))

    return place(start, F.lit(0)), place(stop, n)
