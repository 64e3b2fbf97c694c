"""N-gram Jaccard self-join with rare-first prefixes, and the components of its links.

A text's set holds its distinct n-word shingles as 64-bit hashes. Shingles are
ordered rare first: a table that grows with the texts, from 2^18 to 2^23 hash
buckets, counts over all texts how many sets hold a shingle of each bucket, and a
shingle's rank is its bucket's count, to half an octave. Any order gives exact
results; a rare-first order keeps shared keys few.

Texts with equal sets form a class, and only classes are joined. The prefix
filter joins classes on shingles among the first ``n - ceil(t * n) + 1``; length
and positional filters bound the overlap; the suffix filter compares parities
of set members in hash ranges, 2,048 or twice the set's size (folded to 256 where
rows are many), a lower bound on the Hamming distance. Candidates are made distinct and verified once.

Links are sought in two rounds. First each key's classes are compared with one
of them, the class with the most copies. Then, within keys that still hold
several components, every pair of classes from different components that passes
the filters is verified, so a large group of near copies costs its size rather
than its square, and no component is missed. Keys that ``HOT`` sets or more may
hold, by their rank, are dealt to ``SALTS`` parts for the first round and by size
for the second: a size meets only its own and the next band of sizes, which is as
far as the length filter reaches.

Defined results: null texts and texts without words have empty sets, link with
nothing and are their own component; texts with fewer words than ``n`` are one
shingle; repeated rows get equal rows; columns other than doc_id and text are
not read, so none can clash; a text of any length is one set; of equal texts each
row has its own, equal, result; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import cut, gram_hashes, mix64, span_hashes, spans, text_chunks
from larkspur.llm.components import connected_components

#: Bits of the rank table's size, from bytes of text, and of a rank.
BUCKET_BITS = (18, 23)
RANK_BITS = 6
BYTES_PER_BUCKET = 1 << 9
_SLICE = 1 << 16
#: Keys of buckets with so many sets are split.
HOT = 1 << 13
SALTS = 32
RANGES = 2048
_FOLD = 256
#: Ids that may be broadcast, after they are counted: 16 bytes each. More are joined by a shuffle.
BROADCAST_IDS = 1 << 18
_RUN = 2048


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the offsets of the texts' sets."""
    rows = len(offsets) - 1
    starts, ends, row = spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams, first = gram_hashes(words, row, n)
    own = row[first]
    count = np.bincount(row, minlength=rows)
    for i in np.flatnonzero((count > 0) & (count < n)):  # the whole sequence as one shingle
        lo = int(np.searchsorted(row, i))
        h = mix64(np.array([count[i]], np.uint64))
        for w in words[lo : lo + count[i]]:
            h = mix64(h ^ w)
        grams, own = np.append(grams, h), np.append(own, i)
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    if len(grams):
        fresh = np.append(True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1]))
        grams, own = grams[fresh], own[fresh]
    return grams, np.searchsorted(own, np.arange(rows + 1))


def required(a, b, percent: int):
    """Least overlap of two sets of these sizes: o / (a + b - o) >= percent / 100."""
    return -(-(percent * (a + b)) // (100 + percent))


def bucket_ranks(documents: DataFrame, n: int) -> np.ndarray:
    """How many sets hold a shingle of each bucket, as twice its binary logarithm; a power of two of buckets, 2^23 at most.

    Each task sends its counts in slices of buckets, in as many bytes as they need.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // BYTES_PER_BUCKET).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])

    def count(batches):
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch["text"]):
                np.add.at(total, (shingle_sets(data, offsets, n)[0] >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for k, part in enumerate(total.reshape(-1, _SLICE)):
            most = int(part.max())
            if most:
                kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, np.int64)
        for raw in rows["counts"]:
            raw = raw.as_buffer()
            total += np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw.size // _SLICE])
        ranks = np.minimum(2 * np.log2(np.maximum(total, 1)), (1 << RANK_BITS) - 1).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    got = documents.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(merge, "slice int, ranks binary").toArrow()
    out = np.zeros((1 << bits) // _SLICE, f"V{_SLICE}")
    for k, raw in zip(got["slice"].to_pylist(), got["ranks"].to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, f"V{_SLICE}")[0]
    return out.view(np.uint8)


def hot_rank(sets: int) -> int:
    return int(2 * np.log2(sets))


def _rank(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - RANK_BITS)


def prefixes(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a hash of the set), prefix, parity and its fold of each text."""
    ranks = documents.sparkSession.sparkContext.broadcast(bucket_ranks(documents, n))
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("prefix", T.BinaryType()), T.StructField("parity", T.BinaryType()), T.StructField("fold", T.BinaryType())])

    def make(batches):
        rank = ranks.value
        shift = np.uint64(65 - len(rank).bit_length())
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                grams, bound = shingle_sets(data, offsets, n)
                keys = (rank[(grams >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(64 - RANK_BITS)) | (mix64(grams) >> np.uint64(RANK_BITS))
                ids, prefix, parity, fold = np.zeros(hi - lo, np.int64), [], [], []
                for i in range(hi - lo):
                    own = slice(bound[i], bound[i + 1])
                    size = int(bound[i + 1] - bound[i])
                    p = size - -(-(percent * size) // 100) + 1
                    prefix.append(np.sort(keys[own])[: p if size else 0].tobytes())
                    ranges = max(RANGES, 1 << (2 * size - 1).bit_length()) if size else RANGES
                    odd = np.packbits(np.bincount((grams[own] & np.uint64(ranges - 1)).astype(np.int64), minlength=ranges) & 1)
                    parity.append(odd.tobytes())
                    fold.append(np.bitwise_xor.reduce(odd.reshape(-1, _FOLD // 8)).tobytes())
                    ids[i] = set_hash(grams[own])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(bound)), pa.array(ids), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary()), pa.array(fold, pa.binary())], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(make, schema)


def set_hash(grams: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return (np.add.reduce(mix64(grams ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95))) * np.uint64(2) + np.uint64(len(grams))).astype(np.int64)


def _postings(classes: DataFrame) -> DataFrame:
    """key, set_id, n, at and copies for each prefix member."""

    def explode(batches):
        for batch in batches:
            raw = [np.frombuffer(x.as_py(), np.uint64) for x in batch["prefix"]]
            size = np.array([len(x) for x in raw], np.int64)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            keys = np.concatenate(raw).view(np.int64) if len(raw) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(batch[c].to_numpy(), size)) for c in ("set_id", "n", "copies")], pa.array(at.astype(np.int32))], names=["key", "set_id", "n", "copies", "at"])

    return classes.select("set_id", "n", "copies", "prefix").mapInArrow(explode, "key long, set_id long, n long, copies long, at int")


def _apart(x: bytes, y: bytes) -> int:
    """How many hash ranges differ in parity, the longer one folded to the shorter."""
    a, b = (np.frombuffer(z, np.uint64) for z in sorted((x, y), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets reach the similarity."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("set_id").alias(side), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_parity")), side)

    def close(batches):
        for batch in batches:
            nx, ny = batch["a_n"].to_numpy(), batch["b_n"].to_numpy()
            apart = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch["a_parity"], batch["b_parity"], strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= nx + ny - 2 * required(nx, ny, percent)))

    pairs = cut(pairs.select("a", "b", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(close, "a long, b long"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(classes.select("set_id", F.col("first_id").alias("_id")), "set_id")
    wanted = cut(wanted)
    ids = wanted.select("_id", F.col("set_id").alias("_set"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")))

    def sets(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                grams, bound = shingle_sets(data, offsets, n)
                own = [grams[bound[i] : bound[i + 1]] for i in range(hi - lo)]
                ok = pa.array(np.array([set_hash(x) for x in own], np.int64) == batch["_set"].slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays([batch["_set"].slice(lo, hi - lo), pa.array([x.tobytes() for x in own], pa.binary())], names=["set_id", "members"]).filter(ok)

    members = texts.select("text", "_set").mapInArrow(sets, "set_id long, members binary")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = members.select(F.col("set_id").alias("a"), F.col("members").alias("left")), members.select(F.col("set_id").alias("b"), F.col("members").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(verify, "a long, b long").distinct()


def _near_pairs(percent: int):
    """Candidate pairs of a stream of postings sorted by key and size, from different components."""

    def run(batches):
        kept: list[dict[str, np.ndarray]] = []  # earlier blocks of the key that the length filter may still reach
        for batch in batches:
            cols = {c: batch[c].to_numpy() for c in ("key", "set_id", "n", "at", "part")}
            cols["fold"] = np.frombuffer(b"".join(batch["fold"].to_pylist()), np.uint64).reshape(-1, _FOLD // 64)
            if not len(batch):
                continue
            edges = np.flatnonzero(np.append(True, cols["key"][1:] != cols["key"][:-1]))
            single = np.minimum.reduceat(cols["part"], edges) == np.maximum.reduceat(cols["part"], edges)
            single[[0, -1]] = False  # these keys may reach into other batches
            out = []
            for lo, hi in zip(edges[~single].tolist(), np.append(edges[1:], len(batch))[~single].tolist(), strict=True):
                for s in range(lo, hi, _RUN):
                    block = {c: v[s : min(s + _RUN, hi)] for c, v in cols.items()}
                    kept = [k for k in kept if k["key"][0] == block["key"][0] and 100 * k["n"][-1] >= percent * block["n"][0]]
                    for other in [*kept, block]:
                        out += _block_pairs(other, block, percent, other is block)
                    kept.append(block)
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                a, b = np.minimum(a, b), np.maximum(a, b)
                a, b = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _block_pairs(x: dict, y: dict, percent: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    if same and (len(x["n"]) < 2 or (x["part"] == x["part"][0]).all()):
        return []
    i, j = np.nonzero((x["part"][:, None] != y["part"][None, :]) & (100 * x["n"][:, None] >= percent * y["n"][None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    nx, ny = x["n"][i], y["n"][j]
    need = required(nx, ny, percent)
    ok = np.minimum(nx - x["at"][i], ny - y["at"][j]) + np.minimum(x["at"][i], y["at"][j]) >= need
    i, j, room = i[ok], j[ok], (nx + ny - 2 * need)[ok]
    apart = np.bitwise_count(x["fold"][i] ^ y["fold"][j]).sum(axis=1)
    ok = apart <= room
    return [(x["set_id"][i[ok]], y["set_id"][j[ok]])] if ok.any() else []


def link_components(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, set_id and component_id (smallest doc_id reachable by links) of every row."""
    kind = documents.schema["doc_id"].dataType
    sets = cut(prefixes(documents, n, percent))
    classes = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max(F.struct("n_shingles", "prefix", "parity", "fold")).alias("s"))
    classes = cut(classes.select("set_id", "first_id", "copies", F.col("s.n_shingles").alias("n"), "s.prefix", "s.parity", "s.fold"))

    hot = _rank(F.col("key")) >= hot_rank(HOT)
    postings = _postings(classes).withColumn("part", F.when(hot, F.pmod(F.xxhash64("set_id"), F.lit(SALTS)) + 1).otherwise(0).cast("int"))
    key = Window.partitionBy("key", "part")
    pivot = key.orderBy(F.desc("copies"), "set_id")
    shared = postings.withColumn("pivot", F.first(F.struct("set_id", "n", "at")).over(pivot)).withColumn("held", F.count(F.lit(1)).over(key)).where("held > 1 or part > 0")
    shared = cut(shared.select("key", "set_id", "n", "at", "pivot"))
    a_n, b_n, a_at, b_at = F.col("pivot.n"), F.col("n"), F.col("pivot.at"), F.col("at")
    need = F.ceil(percent * (a_n + b_n) / (100 + percent))
    star = shared.where(
        (F.col("pivot.set_id") != F.col("set_id"))
        & (100 * F.least(a_n, b_n) >= percent * F.greatest(a_n, b_n))
        & (F.least(a_n - a_at, b_n - b_at) + F.least(a_at, b_at) >= need)
    )
    first = cut(_verified(star.select(F.col("pivot.set_id").alias("a"), F.col("set_id").alias("b")), documents, classes, n, percent))
    parts = connected_components(first)
    placed = classes.join(parts, F.col("set_id") == F.col("node"), "left").select("set_id", "fold", F.coalesce("component", "set_id").alias("part"))
    rest = shared.select("key", "set_id", "n", "at").join(placed, "set_id").select("key", "set_id", "n", "at", "part", "fold")
    # a hot key's rows go to their own band of sizes and, as the smaller ones, to the next
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    rest = rest.withColumn("band", F.explode(F.when(hot, F.array(band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    rest = rest.withColumn("key", F.when(hot, F.xxhash64("key", "band")).otherwise(F.col("key"))).drop("band")
    near = rest.repartition("key").sortWithinPartitions("key", "n", "set_id").mapInArrow(_near_pairs(percent), "a long, b long")
    links = first.union(_verified(near, documents, classes, n, percent))
    found = connected_components(links)
    whole = classes.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", "first_id", F.coalesce("component", "set_id").alias("part"))
    least = whole.groupBy("part").agg(F.min("first_id").alias("component_id"))
    by_set = whole.join(least, "part").select(F.col("set_id").alias("_s"), F.col("component_id").cast(kind))
    return sets.join(by_set, (F.col("set_id") == F.col("_s")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
