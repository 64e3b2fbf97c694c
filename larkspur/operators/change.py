"""Changes to record tables as new DataFrames: create, update, delete, and dense renumbering."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Field
from larkspur.functions import numbers
from larkspur.functions.typed import whole_bits
from larkspur.lineage import cut
from larkspur.operators.select import INDEX


def _held(catalog: Catalog, field: Field, value: Column) -> Column:
    """A value brought into its field by the field's overflow policy."""
    whole = whole_bits(catalog.base(field.type))
    return numbers.overflow(value, whole[0], field.policy, whole[1]) if whole else value


def _default(catalog: Catalog, field: Field) -> Column:
    """A field's default; arrays, and the payload of an enum as ``{"_variant": ..., variant: {...}}``, are given as Python values."""
    kind = catalog.spark_type(field.type)
    if isinstance(field.default, list | dict):
        return F.from_json(F.lit(json.dumps(field.default)), kind)
    return F.lit(field.default).cast(kind)


def create(table: DataFrame, rows: DataFrame, catalog: Catalog | None = None, kind: str | None = None) -> DataFrame:
    """Append rows, in the order they are given in, behind the highest index.

    Fields that are not given take the default that the catalog has for them, and
    are null otherwise; a null that is given stays. With a catalog, integers are held
    to their fields by the fields' policies.
    """
    if catalog:
        fields = {f.name: f for f in catalog.types[catalog.base(kind)].fields}
        given = {c: _held(catalog, fields[c], F.col(f"`{c}`")).cast(catalog.spark_type(fields[c].type)) for c in rows.columns if c in fields}
        rows = rows.withColumns(given | {c: _default(catalog, f) for c, f in fields.items() if c not in rows.columns})
    top = table.agg(F.coalesce(F.max(INDEX), F.lit(-1))).first()[0]
    return table.unionByName(dense_index(rows, [], top + 1), allowMissingColumns=True)


def update(table: DataFrame, changes: dict[str, Column], where=None, catalog: Catalog | None = None, kind: str | None = None) -> DataFrame:
    """Set fields of the rows that match; an unknown field is an error before anything changes. Policies as in ``create``."""
    if unknown := set(changes) - set(table.columns):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    if catalog:
        fields = {f.name: f for f in catalog.types[catalog.base(kind)].fields}
        changes = {k: _held(catalog, fields[k], c) if k in fields else c for k, c in changes.items()}
    if where is None:
        return table.withColumns({k: c.cast(table.schema[k].dataType) for k, c in changes.items()})
    hit = F.coalesce(where.column(table), F.lit(False))
    return table.withColumns({k: F.when(hit, c.cast(table.schema[k].dataType)).otherwise(F.col(k)) for k, c in changes.items()})


def delete(table: DataFrame, where=None) -> DataFrame:
    return table.limit(0) if where is None else table.where(~F.coalesce(where.column(table), F.lit(False)))


def dense_index(df: DataFrame, by: list[str], start: int = 0, name: str = INDEX) -> DataFrame:
    """Number the rows from ``start`` in order of ``by``, or as they are given, without passing them through one task.

    The sorted rows are checkpointed, so that their partitions stay as they are;
    the partitions are counted, and each numbers its own rows from its offset.
    """
    rows = cut(df.orderBy(*by) if by else df).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # one number for each partition
    offsets, total = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    table = F.array(*[F.lit(x).cast("long") for x in offsets]) if offsets else F.array(F.lit(0).cast("long"))
    number = F.get(table, F.col("_part")) + F.col("_at")
    return rows.select(number.alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


def compact(table: DataFrame, by: str = INDEX) -> tuple[DataFrame, DataFrame]:
    """(table renumbered from 0, old and new index); references are mapped with ``remap``."""
    numbered = dense_index(table.withColumnRenamed(by, "_old"), ["_old"])  # reads its checkpoint
    return numbered.drop("_old"), numbered.select(F.col("_old").alias("old"), F.col(INDEX).alias("new"))


def remap(table: DataFrame, field: str, ids: DataFrame) -> DataFrame:
    """A reference field in new numbers; a reference to a row that is gone becomes null."""
    out = table.join(ids, table[field] == ids["old"], "left")
    return out.select(*[F.col("new").alias(field) if c == field else table[c] for c in table.columns])
