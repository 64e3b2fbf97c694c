"""Array, set and dictionary functions with 0-based places.

Sets are arrays without repeats that keep the order of insertion; dictionaries are maps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.strings import bounds


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def _items(values) -> Column:
    """Arguments as one array; list arguments are taken apart."""
    flat = []
    for v in values:
        flat += v if isinstance(v, list | tuple) else [v]
    return F.array(*[_lit(v) for v in flat])


def length(a: Column) -> Column:
    return F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0))


def is_empty(a: Column) -> Column:
    return length(a) == 0


def contains(a: Column, v) -> Column:
    return F.coalesce(F.array_contains(a, _lit(v)), F.lit(False))


def smallest(a: Column, key: str | None = None) -> Column:
    return F.array_min(F.transform(a, lambda e: e[key]) if key else a)


def largest(a: Column, key: str | None = None) -> Column:
    return F.array_max(F.transform(a, lambda e: e[key]) if key else a)


def at(a: Column, i: int) -> Column:
    """From the end if negative; null beyond the array."""
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def cut(a: Column, start: int | None = None, stop: int | None = None) -> Column:
    lo, hi = bounds(F.size(a), start, stop)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def sort(a: Column, *keys: tuple[str | None, bool]) -> Column:
    """Stable, by (key, descending) pairs; nulls last when ascending and first when descending."""

    def order(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for key, down in reversed(keys or ((None, False),)):
            p, q = (x[key], y[key]) if key else (x, y)
            before, after = (1, -1) if down else (-1, 1)
            out = (
                F.when(p.isNull() & q.isNull(), out)
                .when(p.isNull(), -before)
                .when(q.isNull(), before)
                .when(p < q, before)
                .when(p > q, after)
                .otherwise(out)
            )
        return out

    return F.array_sort(a, order)


def reverse(a: Column) -> Column:
    return F.reverse(a)


def append(a: Column, *values) -> Column:
    """A null array becomes one of the values."""
    return F.when(a.isNull(), _items(values)).otherwise(F.concat(a, _items(values)))


def prepend(a: Column, *values) -> Column:
    return F.when(a.isNull(), _items(values)).otherwise(F.concat(_items(values), a))


def insert(a: Column, i: int, *values) -> Column:
    """Before place i, held to the array's ends."""
    return F.concat(cut(a, None, i), _items(values), cut(a, i, None))


def _checked(a: Column, places: tuple[int, ...], out: Column) -> Column:
    n = F.size(a)
    ok = F.lit(True)
    for i in places:
        ok &= (F.lit(i) < n) & (F.lit(i) >= -n)
    return F.when(a.isNull(), None).when(ok, out).otherwise(F.raise_error(F.lit(f"index out of range: {places}")))


def delete(a: Column, i: int) -> Column:
    """Without the element at i; an error beyond the array."""
    place = F.lit(i) if i >= 0 else F.size(a) + i
    return _checked(a, (i,), F.filter(a, lambda e, k: k != place))


def remove(a: Column, v) -> Column:
    """Without the first occurrence of v."""
    place = F.array_position(a, _lit(v)).cast("int")
    return F.when(place > 0, F.filter(a, lambda e, k: k != place - 1)).otherwise(a)


def remove_all(a: Column, v) -> Column:
    return F.filter(a, lambda e: ~e.eqNullSafe(_lit(v)))


def replace_first(a: Column, old, new) -> Column:
    place = F.array_position(a, _lit(old)).cast("int")
    return F.when(place > 0, F.transform(a, lambda e, k: F.when(k == place - 1, _lit(new)).otherwise(e))).otherwise(a)


def replace_all(a: Column, old, new) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(_lit(old)), _lit(new)).otherwise(e))


def swap(a: Column, i: int, j: int) -> Column:
    p, q = (F.lit(x) if x >= 0 else F.size(a) + x for x in (i, j))
    return _checked(a, (i, j), F.transform(a, lambda e, k: F.when(k == p, F.get(a, q)).when(k == q, F.get(a, p)).otherwise(e)))


def set_add(s: Column, v) -> Column:
    return F.array_union(s, F.array(_lit(v)))


def set_union(s: Column, t: Column) -> Column:
    return F.array_union(s, t)


def set_intersect(s: Column, t: Column) -> Column:
    return F.array_intersect(s, t)


def set_difference(s: Column, t: Column) -> Column:
    return F.array_except(s, t)


def set_symmetric_difference(s: Column, t: Column) -> Column:
    return F.array_union(F.array_except(s, t), F.array_except(t, s))


def has_key(d: Column, k) -> Column:
    return F.coalesce(F.map_contains_key(d, _lit(k)), F.lit(False))


def keys(d: Column) -> Column:
    return F.map_keys(d)


def values(d: Column) -> Column:
    return F.map_values(d)


def entries(d: Column) -> Column:
    return F.map_entries(d)


def lookup(d: Column, k) -> Column:
    return F.try_element_at(d, _lit(k))


def drop_key(d: Column, k) -> Column:
    return F.map_filter(d, lambda key, _: key != _lit(k))
