"""Rows as text: JSON, YAML, XML and assignment scripts, one value for each row; archives of whole catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import Catalog, Composite
from larkspur.operators.change import compact, remap
from larkspur.operators.select import INDEX


def _fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != INDEX]


def _quoted(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _text(c: Column, kind: T.DataType) -> Column:
    """A value as the script languages write it."""
    if isinstance(kind, T.StringType):
        out = _quoted(c)
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: _text(e, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(_text(e["key"], kind.keyType), F.lit(": "), _text(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}="), _text(c[f.name], f.dataType)) for f in kind.fields]), F.lit(")"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def _xml(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _reference(c: Column, target: str) -> Column:
    return F.concat(F.lit(f"{target}_"), c.cast("string"))


def _json(df: DataFrame, name: str, to: dict[str, str]) -> Column:
    fields = [F.when(F.col(f.name).isNotNull(), F.struct(_reference(F.col(f.name), to[f.name]).alias("$ref"))).alias(f.name) if f.name in to else F.col(f.name) for f in _fields(df)]
    return F.to_json(F.struct(_reference(F.col(INDEX), name).alias("$id"), *fields), {"ignoreNullFields": "false"})


def _named(f: T.StructField, to: dict[str, str], sign: str) -> Column:
    """A field's value, or the name of the row it refers to after a sign."""
    return F.coalesce(F.concat(F.lit(sign), _reference(F.col(f.name), to[f.name])), F.lit("null")) if f.name in to else _text(F.col(f.name), f.dataType)


def _yaml(df: DataFrame, name: str, to: dict[str, str]) -> Column:
    head = F.concat(F.lit("- &"), _reference(F.col(INDEX), name))
    return F.concat_ws("\n", head, *[F.concat(F.lit(f"  {f.name}: "), _named(f, to, "*")) for f in _fields(df)])


def _xml_element(df: DataFrame, name: str, to: dict[str, str]) -> Column:
    def inner(f: T.StructField) -> Column:
        if f.name in to:
            return F.coalesce(F.concat(F.lit(f'<{f.name} ref="#'), _reference(F.col(f.name), to[f.name]), F.lit('"/>')), F.lit(f"<{f.name}>null</{f.name}>"))
        text = F.coalesce(F.col(f.name), F.lit("null")) if isinstance(f.dataType, T.StringType) else _text(F.col(f.name), f.dataType)
        return F.concat(F.lit(f"<{f.name}>"), _xml(text), F.lit(f"</{f.name}>"))

    return F.concat(F.lit(f'<{name} id="'), _reference(F.col(INDEX), name), F.lit('">'), F.concat_ws("", *map(inner, _fields(df))), F.lit(f"</{name}>"))


def _script(df: DataFrame, name: str, to: dict[str, str]) -> Column:
    values = F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}="), _named(f, to, "$_")) for f in _fields(df)])
    return F.concat(F.lit("$_"), _reference(F.col(INDEX), name), F.lit(f" = create {name}("), values, F.lit(")"))


_FORMS = {"json": _json, "yaml": _yaml, "xml": _xml_element, "script": _script}


def dump_json(df: DataFrame, name: str, references: dict[str, str] | None = None) -> DataFrame:
    """An object with ``$id`` and the fields, null ones too; ``references`` (field -> its rows' name) are ``{"$ref": id}``."""
    return df.select(_json(df, name, references or {}).alias("value"))


def dump_yaml(df: DataFrame, name: str, references: dict[str, str] | None = None) -> DataFrame:
    """A list item with an anchor, and a line for each field; a reference is the alias of an anchor."""
    return df.select(_yaml(df, name, references or {}).alias("value"))


def dump_xml(df: DataFrame, name: str, references: dict[str, str] | None = None) -> DataFrame:
    """An element with an id; a reference is an empty element with ``ref``."""
    return df.select(_xml_element(df, name, references or {}).alias("value"))


def dump_script(df: DataFrame, name: str, references: dict[str, str] | None = None) -> DataFrame:
    """A statement that creates each row anew; a reference is the variable of another statement."""
    return df.select(_script(df, name, references or {}).alias("value"))


def references_of(catalog: Catalog, name: str) -> dict[str, str]:
    """Fields of a composite that name rows of another, and which."""
    fields = {f.name: catalog.base(f.type) for f in catalog.types[catalog.base(name)].fields}
    return {k: t for k, t in fields.items() if isinstance(catalog.types.get(t), Composite)}


def closure(catalog: Catalog, names: list[str]) -> list[str]:
    """The composites and all that they refer to, directly or not, in order of declaration."""
    reached, more = set(), {*names}
    while more:
        reached |= more
        more = {t for n in more for t in references_of(catalog, n).values()} - reached
    return [n for n in catalog.types if n in reached]


def dump_order(catalog: Catalog, names: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Composites with what they refer to first, and the references that go back: (composite, field, its target)."""
    order: list[str] = []
    back: list[tuple[str, str, str]] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        open_.append(name)
        for field, target in references_of(catalog, name).items():
            if target in open_:
                back.append((name, field, target))
            elif target not in order and target in names:
                visit(target)
        open_.pop()
        order.append(name)

    for name in names:
        if name not in order:
            visit(name)
    return order, back


def dump(catalog: Catalog, tables: dict[str, DataFrame], form: str, names: list[str] | None = None) -> DataFrame:
    """part, _index and value of all rows of the composites and of those they refer to; parts are in an order in which references come first.

    References that go back, in cycles, name a row that comes later; in a script they
    are null in the row's statement and set by one that follows all rows.
    """
    order, back = dump_order(catalog, closure(catalog, names or [*tables]))
    parts = []
    for i, name in enumerate(order):
        late = [f for n, f, _ in back if n == name] if form == "script" else []
        rows = tables[name].withColumns({f: F.lit(None).cast(tables[name].schema[f].dataType) for f in late}) if late else tables[name]
        parts.append(rows.select(F.lit(i).alias("part"), INDEX, _FORMS[form](rows, name, references_of(catalog, name)).alias("value")))
    for j, (name, field, target) in enumerate(back if form == "script" else []):
        value = F.concat(F.lit("update $_"), _reference(F.col(INDEX), name), F.lit(f" set {field}=$_"), _reference(F.col(field), target))
        parts.append(tables[name].where(F.col(field).isNotNull()).select(F.lit(len(order) + j).alias("part"), INDEX, value.alias("value")))
    return reduce(DataFrame.union, parts)


def archive(spark: SparkSession, catalog: Catalog, tables: dict[str, DataFrame], path: str, references: dict[str, dict[str, str]] | None = None, codec: str = "zstd") -> None:
    """Compact all tables, follow references to their new numbers, and write them with the catalog under ``path``."""
    done = {name: compact(df) for name, df in tables.items()}
    for name, (df, _) in done.items():
        for field, target in (references or {}).get(name, {}).items():
            df = remap(df, field, done[target][1])
        df.write.option("compression", codec).parquet(f"{path}/tables/{name}")
    spark.createDataFrame([(catalog.to_json(),)], "value string").coalesce(1).write.option("wholetext", True).json(f"{path}/catalog")


def restore(spark: SparkSession, path: str, names: list[str]) -> tuple[Catalog, dict[str, DataFrame]]:
    catalog = Catalog.from_json(spark.read.json(f"{path}/catalog").first()["value"])
    return catalog, {n: spark.read.parquet(f"{path}/tables/{n}") for n in names}


__all__ = ["archive", "closure", "dump", "dump_order", "references_of", "dump_json", "dump_script", "dump_xml", "dump_yaml", "restore"]
