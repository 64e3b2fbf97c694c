"""Node and edge graphs over record tables: selection, axes, repetition and set operations.

``nodes`` is (id, selector, name), ``edges`` (axis, source, target). A result is
a set of node ids and a set of edges; every operation is a join or a union, and
repeated traversal keeps a visited set that is cut after each round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog import PRIMITIVES, Alias, Catalog, Composite, Enum, Interface
from larkspur.lineage import cut

ALL = -1


@dataclass
class Result:
    nodes: DataFrame  # id
    edges: DataFrame  # label, source, target

    def _prune(self, nodes: DataFrame) -> Result:
        """These nodes, and the edges with both ends among them."""
        ends = nodes.select(F.col("id").alias("_n"))
        edges = self.edges.join(ends, F.col("source") == F.col("_n"), "left_semi").join(ends, F.col("target") == F.col("_n"), "left_semi")
        return Result(nodes, edges)

    def __or__(self, other: Result) -> Result:
        return Result(self.nodes.union(other.nodes).distinct(), self.edges.union(other.edges).distinct())

    def __and__(self, other: Result) -> Result:
        both = self.nodes.join(other.nodes, "id", "left_semi")
        return Result(both, self.edges.union(other.edges).distinct())._prune(both)

    def __sub__(self, other: Result) -> Result:
        return self._prune(self.nodes.join(other.nodes, "id", "left_anti"))

    def sorted(self, *by: str) -> DataFrame:
        return self.table().orderBy(*by)

    def table(self) -> DataFrame:
        """source, label and target of each edge; nodes without one have empty label and target."""
        ends = self.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        alone = self.nodes.join(ends, "id", "left_anti").select(F.col("id").alias("source"), F.lit("").alias("label"), F.lit("").alias("target"))
        return self.edges.select("source", "label", "target").union(alone)

    def dot(self) -> DataFrame:
        """The graph in DOT, a line for each row, in order."""
        quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
        body = self.table().select(F.lit(1).alias("part"), F.when(F.col("target") == "", F.concat(quoted("source"), F.lit(";"))).otherwise(F.concat(quoted("source"), F.lit(" -> "), quoted("target"), F.lit(" [label="), quoted("label"), F.lit("];"))).alias("value"))
        spark = self.nodes.sparkSession
        frame = spark.createDataFrame([(0, "digraph {"), (2, "}")], "part int, value string")
        return frame.union(body).orderBy("part", "value").select("value")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    groups: dict[str, list[str]] = field(default_factory=dict)
    reverses: dict[str, str] = field(default_factory=dict)

    def _expand(self, name: str) -> list[str]:
        """Members of a group of selectors or axes, groups within groups too."""
        out: list[str] = []
        for m in self.groups.get(name, []):
            out += self._expand(m) if m in self.groups else [m]
        return out or [name]

    def select(self, selector: str, names: list[str] | None = None, but: bool = False, where: Column | None = None) -> Result:
        """Nodes of a selector or a group; an unknown one is empty. ``names`` keeps those names, or all but them."""
        rows = self.nodes.where(F.col("selector").isin(self._expand(selector)))
        if names is not None:
            hit = F.col("name").isin(names)
            rows = rows.where(~hit if but else hit)
        rows = rows if where is None else rows.where(where)
        return Result(rows.select("id").distinct(), self.edges.limit(0).select(F.col("axis").alias("label"), "source", "target"))

    def axis(self, name: str) -> DataFrame:
        """label, source and target of an axis, of each in a group, or of a reversed one."""
        if name in self.reverses:
            forward = self.axis(self.reverses[name])
            return forward.select(F.lit(name).alias("label"), F.col("target").alias("source"), F.col("source").alias("target"))
        parts = self._expand(name)
        flipped = [self.axis(p) for p in parts if p in self.reverses]
        out = self.edges.where(F.col("axis").isin([p for p in parts if p not in self.reverses])).select(F.col("axis").alias("label"), "source", "target")
        for f in flipped:
            out = out.union(f)
        return out

    def step(self, start: Result, name: str, depth: int = 1) -> Result:
        """Nodes and edges reached from ``start`` along an axis; depth 0 is nothing, ALL goes on to the end.

        Each round goes on from the nodes that are new. A round in which none is new is
        the last: its edges count, its nodes do not.
        """
        none = Result(start.nodes.limit(0), start.edges.limit(0))
        if depth == 0:
            return none
        edges, front, seen, n = self.axis(name), start.nodes, start.nodes.distinct(), 0
        nodes, found = none.nodes, none.edges
        while depth == ALL or n < depth:
            out = edges.join(front.select(F.col("id").alias("_n")), F.col("source") == F.col("_n"), "left_semi").distinct()
            marked = out.join(seen.select(F.col("id").alias("_s")), F.col("target") == F.col("_s"), "left")
            marked = cut(marked.select("label", "source", "target", F.col("_s").isNull().alias("_new")))
            found, n = found.union(marked.drop("_new")), n + 1
            if marked.where("_new").isEmpty():
                break
            nodes = nodes.union(marked.select(F.col("target").alias("id")))
            front = marked.where("_new").select(F.col("target").alias("id")).distinct()
            seen = seen.union(front)
        return Result(nodes.distinct(), found.distinct())

    def add(self, start: Result, name: str, depth: int = 1) -> Result:
        """What is there and what the axis reaches."""
        return start | self.step(start, name, depth)

    def either(self, start: Result, names: list[str]) -> Result:
        """What any of several axes reaches."""
        found = self.step(start, names[0])
        for name in names[1:]:
            found = found | self.step(start, name)
        return found

    def chain(self, start: Result, names: list[str]) -> Result:
        """Axis after axis; the edges of the last one stay."""
        for name in names[:-1]:
            start = self.pipe(start, name)
        return self.step(start, names[-1])

    def repeat(self, start: Result, names: list[str], depth: int = ALL) -> Result:
        """The chain of axes again and again from the nodes it finds first, ``depth`` times or to the end."""
        found, front, seen, n = Result(start.nodes.limit(0), start.edges.limit(0)), start, start.nodes, 0
        while depth == ALL or n < depth:
            got = self.chain(front, names)
            fresh = cut(got.nodes.join(seen, "id", "left_anti"))
            found, n = Result(found.nodes.union(got.nodes).distinct(), cut(found.edges.union(got.edges).distinct())), n + 1
            if fresh.isEmpty():
                break
            seen, front = cut(seen.union(fresh)), Result(fresh, start.edges.limit(0))
        return found

    def label(self, found: Result, names: DataFrame, end: str = "target") -> Result:
        """Edges labelled by what ``names`` (id, label) says of their target or source; edges without one keep theirs."""
        told = found.edges.withColumnRenamed("label", "_old").join(names, F.col(end) == F.col("id"), "left")
        return Result(found.nodes, told.select(F.coalesce("label", "_old").alias("label"), "source", "target"))

    def values(self, ids: DataFrame, path: list[str]) -> DataFrame:
        """id and _values: in order, the names that a path of axes leads to from each node; a last step may be a column of the nodes."""
        at = ids.select("id", F.col("id").alias("_at")).distinct()
        axes = {*self.reverses, *self.groups}
        for step in path[:-1]:
            at = self._onward(at, step)
        last = path[-1]
        if last in self.nodes.columns and last not in axes:
            told = at.join(self.nodes.select(F.col("id").alias("_node"), F.col(f"`{last}`").cast("string").alias("_value")), F.col("_at") == F.col("_node"))
        else:
            at = self._onward(at, last)
            told = at.join(self.nodes.select(F.col("id").alias("_node"), "name"), F.col("_at") == F.col("_node"), "left").withColumn("_value", F.coalesce("name", "_at"))
        pairs = told.where("_value is not null").select("id", "_at", "_value").distinct()
        return pairs.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"]).alias("_values"))

    def _onward(self, at: DataFrame, name: str) -> DataFrame:
        onward = self.axis(name).select(F.col("source").alias("_from"), F.col("target").alias("_to"))
        return at.join(onward, F.col("_at") == F.col("_from")).select("id", F.col("_to").alias("_at")).distinct()

    def label_by(self, found: Result, paths: list[list[str]], separator: str = "", end: str = "target") -> Result:
        """Edges labelled by what paths lead to from their target or source, joined in the order of the paths.

        A node of an edge without any value keeps its label.
        """
        ids, names = found.edges.select(F.col(end).alias("id")).distinct(), None
        for i, path in enumerate(paths):
            part = self.values(ids, path).withColumnRenamed("_values", f"_p{i}")
            names = part if names is None else names.join(part, "id", "full")
        parts = [F.coalesce(f"_p{i}", F.array().cast("array<string>")) for i in range(len(paths))]
        return self.label(found, names.select("id", F.array_join(F.flatten(F.array(*parts)), separator).alias("label")), end)

    def project(self, found: Result, name: str) -> Result:
        """Each edge's target replaced by what an axis leads to from it; edges whose target it does not leave go."""
        onward = self.axis(name).select(F.col("source").alias("_from"), F.col("target").alias("_to"))
        edges = found.edges.join(onward, F.col("target") == F.col("_from")).select("label", "source", F.col("_to").alias("target")).distinct()
        return Result(edges.select(F.col("target").alias("id")).distinct(), edges)

    def pipe(self, start: Result, name: str, depth: int = 1) -> Result:
        """What the axis reaches, without edges."""
        got = self.step(start, name, depth)
        return Result(got.nodes, got.edges.limit(0))


def schema_graph(spark: SparkSession, catalog: Catalog) -> Graph:
    """The types of a catalog as nodes, and how they hang together as edges."""
    kinds = {Composite: "composites", Interface: "interfaces", Enum: "enums", Alias: "aliases"}
    nodes = [(p, "primitives", p) for p in PRIMITIVES]
    edges = []
    for name, t in catalog.types.items():
        if t is None:
            continue
        nodes.append((name, kinds[type(t)], name))
        if isinstance(t, Alias):
            edges.append(("alias", name, t.type))
        if isinstance(t, Composite):
            edges += [("interfaces", name, i) for i in t.interfaces] + [("extends", name, t.parent)] * bool(t.parent)
        if isinstance(t, Interface):
            edges += [("extends", name, p) for p in t.parents]
        if isinstance(t, Enum):
            for v in t.variants:
                nodes.append((f"{name}.{v}", "variants", v))
                edges.append(("variants", name, f"{name}.{v}"))
        for f in getattr(t, "fields", []):
            nodes.append((f"{name}.{f.name}", "fields", f.name))
            edges += [("fields", name, f"{name}.{f.name}"), ("type", f"{name}.{f.name}", f.type.removesuffix("[]"))]
    frame = spark.createDataFrame(nodes, "id string, selector string, name string")
    groups = {"types": ["composites", "interfaces", "enums", "aliases", "primitives"], "all_fields": ["fields", "variants"]}
    return Graph(frame, spark.createDataFrame(edges, "axis string, source string, target string"), groups, {"owner": "fields", "children": "extends", "implementers": "interfaces"})
