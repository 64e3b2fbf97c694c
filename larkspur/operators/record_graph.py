"""Graphs built from record tables: rows as nodes, and edges along dotted paths through their fields.

A path starts with a selector and goes on with fields. References and interface
fields lead to the rows they name; arrays, sets and dictionaries to each of their
elements (``key`` and ``value`` choose a side of a dictionary); enum fields into the
payload of the variant that is there, a variant's name between them keeps that
variant only. A path that ends inside an enum or a dictionary goes on through all
fields below it to the nodes they lead to. Arrays and dictionaries hold copies of
rows, which are known by their identity field; references are known by index.

Every path is a chain of projections, explodes and joins on an index. Tables are
scanned for the fields of the path only, and nothing is collected but, for each
selector, whether an identity occurs twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Composite, Enum, Field, Interface
from larkspur.operators.graph import Graph
from larkspur.operators.select import INDEX


@dataclass
class _Found:
    """Ends of a path: the source's index, and the index or the identity of a row of one type."""

    rows: DataFrame  # _src, _to
    kind: str
    by_name: bool


class _Walk:
    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame], identity: str):
        self.catalog, self.tables, self.identity = catalog, tables, identity

    def fields(self, df: DataFrame, fields: list[Field], names: list[str]) -> list[_Found]:
        """From a record in ``_v``, along the named fields; no names: along every field, one step."""
        if not names:
            return [x for f in fields for x in self.value(df.select("_src", F.col("_v")[f.name].alias("_v")), f.type, [])]
        known = {f.name: f for f in fields}
        if names[0] not in known:
            return []
        return self.value(df.select("_src", F.col("_v")[names[0]].alias("_v")), known[names[0]].type, names[1:])

    def value(self, df: DataFrame, kind: str, names: list[str], copied: bool = False) -> list[_Found]:
        """From a value of a type; ``copied`` tells that a composite is the row itself, not its index."""
        kind = kind.strip()
        if kind.endswith("[]"):
            return self.value(df.select("_src", F.explode("_v").alias("_v")), kind[:-2], names, True)
        if kind.startswith("{"):
            key, colon, value = kind[1:-1].partition(":")
            if not colon:
                return self.value(df.select("_src", F.explode("_v").alias("_v")), key, names, True)
            entries, sides = df.select("_src", F.explode("_v").alias("key", "value")), {"key": key, "value": value}
            wanted = [names[0]] if names else [*sides]
            return [x for side in wanted if side in sides for x in self.value(entries.select("_src", F.col(side).alias("_v")), sides[side], names[1:], True)]
        kind = self.catalog.base(kind)
        if kind.endswith("[]") or kind.startswith("{"):
            return self.value(df, kind, names, copied)
        t = self.catalog.types.get(kind)
        if isinstance(t, Enum):
            return self._enum(df, t, names)
        if isinstance(t, Interface):
            return [] if names else [_Found(df.where(F.col("_v._type") == c).select("_src", F.col("_v")[INDEX].alias("_to")), c, False) for c in self.catalog.implementers(kind)]
        if not isinstance(t, Composite):
            return []
        if names:
            if not copied:
                rows = self.tables[kind].select(F.struct("*").alias("_row"))
                df = df.join(rows, F.col("_v") == F.col("_row")[INDEX]).select("_src", F.col("_row").alias("_v"))
            return self.fields(df, t.fields, names)
        if not copied:
            return [_Found(df.select("_src", F.col("_v").alias("_to")), kind, False)]
        if not any(f.name == self.identity for f in t.fields):
            return self.fields(df, t.fields, [])
        return [_Found(df.select("_src", F.col("_v")[self.identity].cast("string").alias("_to")), kind, True)]

    def _enum(self, df: DataFrame, t: Enum, names: list[str]) -> list[_Found]:
        payloads = {k: v for k, v in t.variants.items() if isinstance(v, list) and v}
        if names and names[0] in t.variants:
            payloads, names = {k: v for k, v in payloads.items() if k == names[0]}, names[1:]
        found = []
        for variant, fields in payloads.items():
            inside = df.where(F.col("_v._variant") == variant).select("_src", F.col("_v")[variant].alias("_v"))
            found += self.fields(inside, fields, names)
        return found


def record_graph(
    catalog: Catalog,
    tables: dict[str, DataFrame],
    selectors: dict[str, str],
    axes: dict[str, list[str]],
    identity: str = "name",
    groups: dict[str, list[str]] | None = None,
    reverses: dict[str, str] | None = None,
) -> Graph:
    """Nodes of each selector's type, named by ``identity``, and the edges of each axis.

    Where an identity occurs twice in a selector, its nodes are those that an axis
    reaches, as ``source.name``. Rows without an identity are no nodes.
    """
    walk, of_type = _Walk(catalog, tables, identity), {t: s for s, t in reversed(selectors.items())}
    shared, known, nodes = set(), {}, []
    for selector, kind in selectors.items():
        rows = tables[kind].where(F.col(identity).isNotNull()).select(F.col(INDEX).alias("_i"), F.col(identity).cast("string").alias("_name"))
        if rows.groupBy("_name").count().where("count > 1").isEmpty():
            known[kind] = rows.withColumn("_id", F.col("_name"))
            nodes.append(known[kind].select(F.col("_id").alias("id"), F.lit(selector).alias("selector"), F.col("_name").alias("name")))
        else:
            shared.add(kind)
    edges = []
    for axis, paths in axes.items():
        for path in paths:
            selector, *names = path.split(".")
            source = selectors.get(selector)
            if not names or source not in known:
                continue
            start = tables[source].select(F.col(INDEX).alias("_src"), F.struct("*").alias("_v"))
            ids = known[source].select(F.col("_i").alias("_src"), F.col("_id").alias("source"))
            for found in walk.fields(start, catalog.types[catalog.base(source)].fields, names):
                if found.kind not in of_type:
                    continue
                edge, more = _ends(found, ids, tables, known, shared, identity)
                edges.append(edge.select(F.lit(axis).alias("axis"), "source", "target"))
                if found.kind in shared or found.by_name:
                    nodes.append(edge.select(F.col("target").alias("id"), F.lit(of_type[found.kind]).alias("selector"), F.col("_name").alias("name")))
                if more is not None:
                    known[found.kind] = more if found.kind not in known else known[found.kind].union(more).dropDuplicates(["_i"])
    spark = next(iter(tables.values())).sparkSession
    all_edges = reduce(DataFrame.union, edges) if edges else spark.createDataFrame([], "axis string, source string, target string")
    return Graph(reduce(DataFrame.union, nodes).distinct(), all_edges.distinct(), groups or {}, reverses or {})


def _ends(found: _Found, ids: DataFrame, tables: dict[str, DataFrame], known: dict[str, DataFrame], shared: set[str], identity: str) -> tuple[DataFrame, DataFrame | None]:
    """source, target and _name of a path's ends, and what is newly known of rows with shared identities."""
    rows = found.rows.where(F.col("_to").isNotNull()).join(ids, "_src")
    if found.by_name:
        named, index = rows.withColumn("_name", F.col("_to")), None
    elif found.kind in shared:
        other = tables[found.kind].where(F.col(identity).isNotNull()).select(F.col(INDEX).alias("_i"), F.col(identity).cast("string").alias("_name"))
        named, index = rows.join(other, F.col("_to") == F.col("_i")), "_i"
    else:
        return rows.join(known[found.kind], F.col("_to") == F.col("_i")).select("source", F.col("_id").alias("target"), "_name"), None
    target: Column = F.concat_ws(".", "source", "_name") if found.kind in shared else F.col("_name")
    named = named.withColumn("target", target)
    more = named.select("_i", "_name", F.col("target").alias("_id")) if index else None
    return named.select("source", "target", "_name"), more
