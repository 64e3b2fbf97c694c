"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors by a random Gaussian map to 8 dimensions and
decodes the image to the nearest point of the E8 lattice; that point is the
vector's cell. Of two vectors the one with the smaller class id also probes the
``probes`` next cells, reached by decoding the image pushed across the walls it
lies nearest to. Vectors that meet in a cell of any table are compared by cosine
in double precision.

Vectors that are equal, with equal labels, are one class with a multiplicity.
A pair is counted only in the first table in which it meets, which both rows can
tell from the cells they carry, so links are counted without making the pairs:
a cell returns one count for each member and the edges of a spanning forest.
Cells with more than ``block`` members are cut into blocks, each pair of which
is a group of its own.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, and rows with a null label, link with nothing and are
kept; vectors of other lengths are compared only with their like; repeated rows
link with each other; a cosine of exactly ``least`` is a link; an empty table gives
no rows; columns other than vec_id, embedding and label are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import cut, mix64
from larkspur.llm.components import connected_components

TABLES = 8
PROBES = 3
SCALE = 1.7
BLOCK = 2048


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row, in halves: the better of the nearest points of D8 and D8 + 1/2."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        odd = f.sum(axis=1) % 2 != 0
        off = y - f
        k = np.abs(off).argmax(axis=1)
        rows = np.flatnonzero(odd)
        f[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return (2 * np.where(near[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def cells(vectors: np.ndarray, tables: int, probes: int, scale: float = SCALE, seed: int = 11) -> np.ndarray:
    """Cell hashes, (rows, tables, 1 + probes), the home cell first."""
    rng, roots = np.random.default_rng(seed + vectors.shape[1]), _roots()
    out = np.zeros((len(vectors), tables, 1 + probes), np.uint64)
    for t in range(tables):
        image = vectors @ (rng.normal(size=(vectors.shape[1], 8)) * scale) + rng.uniform(-4, 4, 8)
        home = decode_e8(image)
        toward = (image - home / 2) @ roots.T  # a wall is nearer the larger this is
        best = np.argsort(-toward, axis=1)[:, :probes]
        for k in range(1 + probes):
            point = home if k == 0 else home + (2 * roots[best[:, k - 1]]).astype(np.int64)
            h = np.full(len(vectors), t + 1, np.uint64)
            for c in point.T:
                h = mix64(h * np.uint64(31) ^ c.astype(np.uint64))
            out[:, t, k] = h
    return out


def _with_cells(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """The classes with their cells in all tables."""
    schema = T.StructType([*classes.schema.fields, T.StructField("cells", T.BinaryType())])

    def place(batches):
        for batch in batches:
            vectors = [np.frombuffer(v.as_py(), np.float64) for v in batch["vector"]]
            out: list[bytes] = [b""] * len(vectors)
            for size in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    x = np.stack([vectors[i] for i in part])
                    for i, found in zip(part, cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes), strict=True):
                        out[i] = found.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return classes.mapInArrow(place, schema)


def _places(classes: DataFrame, probes: int) -> DataFrame:
    """A row for each class and cell, without the vector: at home in it (probe false) or probing it."""

    def explode(batches):
        for batch in batches:
            found = np.frombuffer(b"".join(batch["cells"].to_pylist()), np.int64).reshape(len(batch), -1)
            n = found.shape[1] if len(batch) else 0
            row = pa.array(np.repeat(np.arange(len(batch)), n))
            yield pa.RecordBatch.from_arrays([batch["label"].take(row), pa.array(found.ravel()), pa.array(np.tile(np.arange(n) % (1 + probes) > 0, len(batch))), batch["class"].take(row)], names=["label", "cell", "probe", "class"])

    return classes.select("label", "class", "cells").mapInArrow(explode, "label string, cell long, probe boolean, class long")


def _compare(tables: int, probes: int, least: float):
    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, copies = group["class"].to_numpy(), group["copies"].to_numpy()
        side, probe = group["side"].to_numpy(), group["probe"].to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(group["cells"].to_pylist()), np.uint64).reshape(len(ids), tables, 1 + probes)
        slot = int(np.argwhere(codes[0] == np.uint64(key[1].as_py() % 2**64))[0][0])  # the table this cell is of
        sizes = np.array([len(v.as_py()) for v in group["vector"]])
        links, parent = np.zeros(len(ids), np.int64), {int(i): int(i) for i in ids}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = np.stack([np.frombuffer(group["vector"][int(i)].as_py(), np.float64) for i in own])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            # the smaller class id is the one that probes; the other must be at home here
            left, right = own[(side[own] & 1) > 0], own[((side[own] & 2) > 0) & ~probe[own]]
            where = {int(i): k for k, i in enumerate(own)}
            xl, xr = x[[where[int(i)] for i in left]], x[[where[int(i)] for i in right]]
            for lo in range(0, len(left), 512):
                a = left[lo : lo + 512]
                i, j = np.nonzero((xl[lo : lo + 512] @ xr.T >= least - 1e-12) & (ids[a][:, None] < ids[right][None, :]))
                for s in range(0, len(i), 1 << 18):
                    p, q = a[i[s : s + (1 << 18)]], right[j[s : s + (1 << 18)]]
                    exact = np.einsum("ij,ij->i", x[[where[int(k)] for k in p]], x[[where[int(k)] for k in q]]) >= least
                    first = exact.copy()
                    for t in range(slot):  # met in an earlier table
                        first &= ~(codes[p, t] == codes[q, t, :1]).any(axis=1)
                    np.add.at(links, p[first], copies[q[first]])
                    np.add.at(links, q[first], copies[p[first]])
                    p, q = p[exact], q[exact]
                    at = np.array([root(int(i)) for i in ids])  # pairs within one tree need no step
                    apart = at[p] != at[q]
                    for u, v in np.unique(np.stack([at[p[apart]], at[q[apart]]]), axis=1).T.tolist():
                        if (ru := root(u)) != (rv := root(v)):
                            parent[max(ru, rv)] = min(ru, rv)
        at = np.array([root(int(i)) for i in ids], np.int64)
        some = np.flatnonzero((links > 0) | (at != ids))
        return pa.table({"class": pa.array(ids[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(at[some], pa.int64())})

    return compare


def link(embeddings: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = embeddings.schema["vec_id"].dataType
    doubles = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    usable &= F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.when(usable, doubles).alias("v"))
    # equal vectors with equal labels, told apart by the vectors themselves
    known = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], batch["first_id"], batch["copies"], pa.array([(np.array(v.as_py(), np.float64) + 0.0).tobytes() for v in batch["v"]], pa.binary())], names=["label", "first_id", "copies", "vector"])

    classes = known.mapInArrow(pack, T.StructType([T.StructField("label", T.StringType()), T.StructField("first_id", kind), T.StructField("copies", T.LongType()), T.StructField("vector", T.BinaryType())]))
    # a class is a number of its own; rows find theirs again by two hashes, which for n vectors fail with odds of n^2 / 2^129
    marks = [F.xxhash64("label", "vector").alias("mark"), F.xxhash64(F.lit("again"), "vector", "label").alias("mark2")]
    classes = cut(_with_cells(classes.select("*", *marks).withColumn("class", F.monotonically_increasing_id()), tables, probes))
    members = _places(classes, probes)
    key = ["label", "cell"]
    # only cells in which a pair can meet get their vectors; most cells hold one class
    busy = members.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("home")).where("held > 1 and home > 0")
    busy = busy.withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    placed = members.join(busy, key).withColumn("at", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # each ordered pair of blocks is a group; a row is on the left (1), on the right (2) or, in a block of its own, on both
    turns = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.array(F.struct(F.col("at").alias("l"), k.alias("r"), F.when(F.col("at") == k, 3).otherwise(1).alias("side")), F.struct(k.alias("l"), F.col("at").alias("r"), F.when(F.col("at") == k, 0).otherwise(2).alias("side"))))
    dealt = placed.withColumn("_t", F.explode(F.flatten(turns))).where("_t.side > 0").select(*key, F.col("_t.l").alias("l"), F.col("_t.r").alias("r"), F.col("_t.side").alias("side"), "probe", "class")
    dealt = dealt.join(classes.select("class", "copies", "vector", "cells"), "class")
    got = cut(dealt.groupBy(*key, "l", "r").applyInArrow(_compare(tables, probes, least), "class long, links long, root long"))
    parts = connected_components(got.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = got.groupBy("class").agg(F.sum("links").alias("links"))
    whole = classes.join(counts, "class", "left").join(parts, F.col("class") == F.col("node"), "left")
    whole = whole.select("mark", "mark2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("part"))
    least_id = whole.groupBy("part").agg(F.min("first_id").alias("component_id"))
    by_class = whole.join(least_id, "part").select(F.col("mark").alias("_m"), F.col("mark2").alias("_m2"), "n_links", "component_id")

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([None if v.as_py() is None else (np.array(v.as_py(), np.float64) + 0.0).tobytes() for v in batch["v"]], pa.binary())], names=["vec_id", "label", "vector"])

    named = rows.mapInArrow(name, T.StructType([T.StructField("vec_id", kind), T.StructField("label", T.StringType()), T.StructField("vector", T.BinaryType())]))
    named = named.select("vec_id", *[F.when(F.col("vector").isNotNull(), m).alias(c) for m, c in zip(marks, ("mark", "mark2"), strict=True)])
    out = named.join(by_class, (F.col("mark") == F.col("_m")) & (F.col("mark2") == F.col("_m2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
