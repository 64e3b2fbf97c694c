"""One-source selection: where, group, sort, offset and limit, in that order, then projection.

A record table carries ``_index``, which orders its rows. Grouping keeps one
representative, the row with the lowest index, for columns that are neither
keys nor aggregates; groups come in order of their first row. Sorting is
ascending, nulls first, ties by index. Aggregates without grouping run after the
limit. An unknown column is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "_index"


@dataclass(frozen=True)
class Agg:
    """count, sum, average, product, min or max of a column; count counts rows, null or not."""

    name: str
    field: str | None = None

    @property
    def label(self) -> str:
        return f"{self.name}({self.field or '*'})"


@dataclass(frozen=True)
class Expr:
    """A named expression of columns."""

    label: str
    column: Column


def column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string").alias(name)


def _numeric(df: DataFrame, name: str) -> Column | None:
    """The column as a number, booleans as 0 and 1; None for all other types, which aggregate to null."""
    kind = df.schema[name].dataType if name in df.columns else None
    if isinstance(kind, T.BooleanType):
        return F.col(f"`{name}`").cast("int")
    return F.col(f"`{name}`") if isinstance(kind, T.NumericType) else None


@F.pandas_udf(T.StringType())
def _whole_product(x: pd.Series) -> str:
    out = 1
    for v in x.dropna():
        out *= int(v)
    return str(out) if x.notna().any() else None


def aggregate(df: DataFrame, agg: Agg) -> Column:
    if agg.name == "count":
        return F.count(F.lit(1))
    x = _numeric(df, agg.field)
    if x is None:
        return F.lit(None).cast("double")
    if agg.name == "product":
        return F.product(x)
    return {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}[agg.name](x)


def exact_product(df: DataFrame, field: str, keys: list[str] | None = None) -> DataFrame:
    """The exact product of integers as decimal text: partial products of each batch first, then their product."""
    keys = keys or []
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("product", T.StringType())])

    def partial(batches):
        for pdf in batches:
            pdf = pdf.dropna(subset=[field])
            if not keys:
                out = 1
                for v in pdf[field]:
                    out *= int(v)
                if len(pdf):
                    yield pd.DataFrame({"product": [str(out)]})
                continue
            rows: dict[tuple, int] = {}
            for row in pdf.itertuples(index=False, name=None):
                rows[row[:-1]] = rows.get(row[:-1], 1) * int(row[-1])
            if rows:
                yield pd.DataFrame([(*k, str(v)) for k, v in rows.items()], columns=schema.names)

    parts = df.select(*keys, field).mapInPandas(partial, schema)
    return parts.groupBy(*keys).agg(_whole_product("product").alias("product"))


def select(df: DataFrame, items, where=None, group_by=(), sort_by=(), offset: int = 0, limit: int | None = None) -> DataFrame:
    """``items``: column names, Agg and Expr, or "*" for all columns."""
    items = [*df.columns] if items == "*" else [Expr(x, column(df, x)) if isinstance(x, str) and x not in df.columns else x for x in items]
    rows = df.where(where.column(df)) if where is not None else df
    aggs = [x for x in items if isinstance(x, Agg)]
    if group_by:
        # only the columns that are asked for travel with the representative
        plain = [x for x in dict.fromkeys([*(x for x in items if isinstance(x, str)), *sort_by]) if x not in group_by]
        exprs = {x.label: x.column for x in items if isinstance(x, Expr)}
        shape = [*(F.col(f"`{x}`") for x in plain), *(c.alias(k) for k, c in exprs.items())]
        first = [F.min_by(F.struct(*shape), INDEX).alias("_rep")] if shape else []
        grouped = rows.groupBy(*group_by).agg(F.min(INDEX).alias("_first"), *first, *(aggregate(df, a).alias(a.label) for a in aggs))
        named = {x: F.col("_rep")[x] for x in [*plain, *exprs]} | {k: F.col(f"`{k}`") for k in group_by}
        order = [named[k].asc_nulls_first() for k in sort_by]
        out = _slice(grouped.orderBy(*order, "_first"), offset, limit)
        return out.select(*[F.col(f"`{x.label}`") if isinstance(x, Agg) else named[x if isinstance(x, str) else x.label].alias(x if isinstance(x, str) else x.label) for x in items])
    order = [F.col(f"`{k}`").asc_nulls_first() for k in sort_by if k in df.columns]
    if aggs:
        if offset or limit is not None:
            rows = _slice(rows.orderBy(*order, INDEX), offset, limit)
        place = F.struct(*[F.struct(F.col(f"`{k}`").isNotNull().alias("known"), F.col(f"`{k}`")) for k in sort_by], F.col(INDEX))
        pick = lambda c: F.min_by(c, place)  # noqa: E731  a plain column beside an aggregate: the first row's
        return rows.agg(*[aggregate(df, x).alias(x.label) if isinstance(x, Agg) else pick(x.column if isinstance(x, Expr) else F.col(f"`{x}`")).alias(x.label if isinstance(x, Expr) else x) for x in items])
    out = _slice(rows.orderBy(*order, INDEX) if order or offset or limit is not None else rows, offset, limit)
    return out.select(*[x.column.alias(x.label) if isinstance(x, Expr) else F.col(f"`{x}`") for x in items])


def _slice(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def follow(df: DataFrame, path: list[tuple[str, DataFrame, str]], target: str, label: str | None = None) -> DataFrame:
    """Follow references hop by hop: each (field, table, its index column); a missing target gives null.

    Left joins on the index; Spark measures the tables and broadcasts the small ones.
    """
    out, field = df, None
    for i, (name, other, key) in enumerate(path):
        field = f"_hop{i}_"
        step = other.select(*[F.col(c).alias(f"{field}{c}") for c in other.columns])
        here = f"_hop{i - 1}_{name}" if i else name
        out = out.join(step, out[here] == step[f"{field}{key}"], "left")
    return out.select(*[df[c] for c in df.columns], F.col(f"{field}{target}").alias(label or ".".join([p[0] for p in path] + [target])))


def collect(*sources: DataFrame, key: str = INDEX) -> DataFrame:
    """Rows of several selections of one type, each once, in order of first appearance.

    The result has ``_order``: (source, index) of the first appearance.
    """
    parts = [s.withColumn("_order", F.struct(F.lit(i).alias("source"), F.col(key).alias("at"))) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    others = [c for c in sources[0].columns if c != key]
    return rows.groupBy(key).agg(F.min("_order").alias("_order"), *[F.min_by(c, "_order").alias(c) for c in others])
