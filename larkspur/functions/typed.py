"""Values that carry a declared type through arithmetic.

A plain column beside a typed value takes its type; two different types do not mix,
which is told when the plan is made. Integers stay in their range by their policy,
and both divisions of integers round toward minus infinity. Plain operands of
integers are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Enum
from larkspur.functions import numbers as N


def whole_bits(name: str) -> tuple[int, bool] | None:
    """Bits and sign of an integer type of up to 64 bits."""
    bits = name.removeprefix("u").removeprefix("int")
    return (int(bits), not name.startswith("u")) if bits in ("8", "16", "32", "64") and "int" in name else None


@dataclass
class Typed:
    value: Column
    kind: str
    policy: str | None = None

    def _with(self, other, of: Callable[[Column, Column], Column]) -> Typed:
        if isinstance(other, Typed) and other.kind != self.kind:
            raise TypeError(f"types do not match: {self.kind} and {other.kind}")
        policy = self.policy or (other.policy if isinstance(other, Typed) else None)
        out = of(self.value, _plain(other))
        if bits := whole_bits(self.kind):
            return Typed(N.overflow(out, bits[0], policy or "error", bits[1]), self.kind, policy)
        return Typed(out.cast("double" if self.kind == "float64" else "float"), self.kind, policy)

    def _wide(self, c: Column) -> Column:
        return c.cast("decimal(20,0)") if whole_bits(self.kind) else c.cast("double")

    def __add__(self, other) -> Typed:
        return self._with(other, lambda a, b: self._wide(a) + self._wide(b))

    def __sub__(self, other) -> Typed:
        return self._with(other, lambda a, b: self._wide(a) - self._wide(b))

    def __rsub__(self, other) -> Typed:
        return self._with(other, lambda a, b: self._wide(b) - self._wide(a))

    def __mul__(self, other) -> Typed:
        if bits := whole_bits(self.kind):
            policy = self.policy or (other.policy if isinstance(other, Typed) else None)
            return self._with(other, lambda a, b: N.multiply(a, b, bits[0], policy or "error", bits[1]))
        return self._with(other, lambda a, b: self._wide(a) * self._wide(b))

    def __truediv__(self, other) -> Typed:
        return self._with(other, N.floor_div if whole_bits(self.kind) else N.true_div)

    def __floordiv__(self, other) -> Typed:
        return self._with(other, N.floor_div)

    def __mod__(self, other) -> Typed:
        return self._with(other, N.floor_mod)

    __radd__, __rmul__ = __add__, __mul__

    def concat(self, other) -> Column:
        """Both as one text."""
        return F.concat(self.value.cast("string"), _plain(other).cast("string"))


def _plain(x) -> Column:
    return x.value if isinstance(x, Typed) else x if isinstance(x, Column) else F.lit(x)


def typed(catalog: Catalog, value, kind: str, policy: str | None = None) -> Typed:
    """A value of a type or an alias: an error if it is out of range. Variants of an enum with a backing type become numbers of it."""
    name = catalog.base(kind)
    t = catalog.types.get(name)
    if isinstance(t, Enum):
        if not t.backing:
            raise TypeError(f"{kind} has no backing type")
        return Typed(N.enum_value(_plain(value), t.variants), t.backing, policy)
    bits = whole_bits(name)
    if not bits and not name.startswith("float"):
        raise TypeError(f"no arithmetic on {kind}")
    return Typed(N.convert(_plain(value), *bits) if bits else _plain(value).cast(catalog.spark_type(name)), name, policy)
