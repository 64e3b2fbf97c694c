"""Record tables over Parquet, and views across them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import Catalog
from larkspur.operators.select import INDEX

#: What orders and names the rows of the star schema's tables: an expression of their keys.
KEYS = {
    "region": "CAST(r_regionkey AS BIGINT)",
    "nation": "CAST(n_nationkey AS BIGINT)",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey * 8 + l_linenumber",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
}


def parquet_table(spark: SparkSession, path: str, index: str) -> DataFrame:
    """A Parquet table as a record table. ``index`` is an expression of the key, so no global sort numbers the rows."""
    df = spark.read.parquet(path)
    return df.select(F.expr(index).cast("long").alias(INDEX), *df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_table(spark, f"{sf_dir}/{name}.parquet", KEYS[name])


def interface_view(tables: dict[str, DataFrame], fields: dict[str, dict[str, str]]) -> DataFrame:
    """Rows of all implementing tables with ``_type`` and ``_index``; ``fields``: field -> table -> its column there."""
    parts = [df.select(F.lit(t).alias("_type"), INDEX, *[F.col(cols[t]).alias(f) for f, cols in fields.items()]) for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def type_scan(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """``_source, _index, _field, _value`` of each (table, column) of one type; nulls are left out."""
    parts = [tables[t].where(F.col(c).isNotNull()).select(F.lit(t).alias("_source"), INDEX, F.lit(c).alias("_field"), F.col(c).alias("_value")) for t, c in columns]
    return reduce(DataFrame.union, parts)


def typed_columns(catalog: Catalog, tables: dict[str, DataFrame], name: str) -> list[tuple[str, str]]:
    """(table, column) of each field of a type, for ``type_scan`` and ``enum_overview``; tables that are not there are left out."""
    return [(t, c) for t, c in catalog.fields_of(name) if t in tables]


def enum_overview(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """``_source, _index, _field, _variant, value`` of each enum column; value reads ``variant(field=value, ...)``."""
    parts = []
    for t, c in columns:
        kind = tables[t].schema[c].dataType
        variant, value = (F.col(c)["_variant"], _payload(c, kind)) if isinstance(kind, T.StructType) else (F.col(c), F.col(c))
        parts.append(tables[t].where(variant.isNotNull()).select(F.lit(t).alias("_source"), INDEX, F.lit(c).alias("_field"), variant.alias("_variant"), value.alias("value")))
    return reduce(DataFrame.union, parts)


def _payload(c: str, kind: T.StructType) -> Column:
    out = F.col(c)["_variant"]
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            inner = F.concat_ws(", ", *[F.concat(F.lit(f"{p.name}="), F.col(c)[f.name][p.name].cast("string")) for p in f.dataType.fields])
            out = F.when(F.col(c)["_variant"] == f.name, F.concat(F.lit(f.name), F.lit("("), inner, F.lit(")"))).otherwise(out)
    return out


def variant_scan(source: str, df: DataFrame, column: str, variant: str) -> DataFrame:
    """Payload fields of one variant as columns."""
    return df.where(F.col(column)["_variant"] == variant).select(F.lit(source).alias("_source"), INDEX, F.lit(column).alias("_field"), F.col(f"{column}.{variant}.*"))


def entry_scan(df: DataFrame, column: str) -> DataFrame:
    """Entries of a dictionary column."""
    return df.select(INDEX, F.explode(column).alias("key", "value"))


def rows_by_index(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows in the order of a list of indices (pos, id); unknown indices are left out."""
    return places.join(df, places["id"] == df[INDEX]).orderBy("pos").drop("pos", "id")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One variant value for each JSON document, a line each."""
    return spark.read.text(path).select(F.parse_json("value").alias("document"))
