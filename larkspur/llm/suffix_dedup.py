"""Suffix-array dedup: every byte that a repeated string of ``length`` bytes covers, but for its first occurrence.

Windows of ``length`` bytes are dealt by their minimiser: the least hash of the
``gram``-byte strings in them. Neighbouring windows with one minimiser form a
segment, so equal windows always lie in segments of one key, and segments are
few. Segments whose key occurs once hold no repeat. Of equal segments only the
first, by document id and place, can hold a first occurrence: the others are
removed whole. Segments are equal if they have one key (44 bits of their least
gram's hash), one 64-bit hash of all their bytes and one length; among n segments of a
key, two different ones pass for equal with odds of about n^2 / 2^65. Copies within a
chunk of texts are told apart before anything is shuffled, so a passage that many
texts share sends one segment a chunk to its key, not one a text. What remains are
first segments of keys with several different segments, or with a repeat inside one;
only their bytes are fetched.

Those go, key by key, through a suffix array: its Burrows-Wheeler transform is
extended backward breadth first. Two suffixes part at depth l + 1 when what
follows their first byte parts at depth l, so common-prefix values come in
increasing order, each position is settled once, and the expansion stops at
``length``. The suffixes between two settled positions share a window, and each
that is not the first of them is a repeat.

Segments of keys with more than ``hot`` different ones are cut again by minimisers
of 96 bytes, and where that leaves more than ``hot`` to a key, into their single
windows. First places there are minima by key and content, and a document's pieces
meet them at the document, so neither bytes nor suffix arrays follow a passage that
many texts share. (The windows over coarse segments hold a key's different segments
of all chunks in one task, without bytes.)

Defined results: null and empty texts have no bytes; rows that repeat a document,
id and text alike, are that document and come out alike; rows with one id and
different texts are different documents, ordered by a hash of the text; null ids
come first; a text of any length is cut whole, in pieces that overlap by a window;
an empty table gives no rows; columns other than doc_id and text are not read, so
none can clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import CHUNK_BYTES, cut, mix64, text_chunks

LENGTH = 100
GRAM = 40
FINE_GRAM = 96
HOT = 2000
#: Rows and spans that may be broadcast, after they are counted. More are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
BROADCAST_SPANS = 1 << 21
_NO_ID = -(2**63)
_CHUNK = 1 << 20
_LOW48 = np.uint64((1 << 48) - 1)

_rng = np.random.default_rng(97)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_TOP = 2 * CHUNK_BYTES
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made once per worker."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            _POWERS.append(np.cumprod(np.append(np.uint64(1), np.full(_TOP, base, np.uint64))))
    return _POWERS[0], _POWERS[1]


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of the base; differences of them are hashes of any stretch."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _powers()[0][: len(data)], out=total[1:])
    return total


def _grams(total: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, well mixed in its high bits."""
    x = (total[k:] - total[:-k]) * _powers()[1][: len(total) - k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(start, stop, key, print, again) of the segments of texts laid end to end; ``ends`` gives each byte's text's end.

    ``again`` tells that a key's gram occurs more than once in the segment.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    total = _prefix_sums(data)
    hashes = _grams(total, gram)
    packed = (hashes >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(packed, length - gram + 1)
    valid = np.arange(len(least)) + length <= ends[: len(least)]
    value = least >> np.uint64(20)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (value[1:] != value[:-1]) | (ends[1 : len(least)] != ends[: len(least) - 1])
    start = np.flatnonzero(fresh)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | fresh[1:]
    stop = np.flatnonzero(last) + length
    moved = np.concatenate([[0], np.cumsum(least[1:] != least[:-1])])
    again = moved[stop - length] > moved[start]
    mark = mix64((total[stop] - total[start]) * _powers()[1][start] + (stop - start).astype(np.uint64))
    return start, stop, (mix64(value[start]) & _LOW48).astype(np.int64), mark.view(np.int64), again


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Pieces of a chunk of less than CHUNK_BYTES: (data, end of each byte's text, rows, starts of the bytes in them)."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for lo in range(0, len(data), CHUNK_BYTES - length):
        hi = min(lo + CHUNK_BYTES - 1, len(data))  # a window belongs to the piece it starts in
        own = row[lo:hi]
        yield data[lo:hi], np.minimum(offsets[own + 1], hi) - lo, own, np.arange(lo, hi) - offsets[own]


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols at least, and where the ones that tie with each begin.

    Eight symbols make the first key; then ranks of stretches are put together, three at a time.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    k, by = 8, 3 if n < (1 << 21) - 1 else 2
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        fresh = np.append(True, sorted_[1:] != sorted_[:-1])
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if k >= depth or fresh.all():
            return order, np.flatnonzero(fresh)[rank - 1]
        ranks = np.concatenate([rank, np.zeros((by - 1) * k, np.int64)])
        key = rank
        for j in range(1, by):  # by * log2(n + 1) bits stay below 63
            key = key * (n + 1) + ranks[j * k : j * k + n]
        k *= by


def window_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in suffix-array order, and where a run of suffixes with one prefix of ``length`` symbols begins.

    Symbol 0 ends a segment and is never extended, so the runs hold for stretches without it.
    """
    n = len(symbols)
    order, place = suffix_array(symbols, length)
    before = symbols[order - 1]  # the transform: what precedes each suffix (for the first, the last symbol, a 0)
    settled = np.append(True, symbols[order][1:] != symbols[order][:-1])  # depth 0: first symbols differ
    fresh = settled.copy()
    extend = np.flatnonzero(before)
    extend = extend[np.argsort(before[extend], kind="stable")]
    same = before[extend][1:] == before[extend][:-1]
    to = place[order[extend] - 1][1:][same].astype(np.int32)
    later, earlier = extend[1:][same].astype(np.int32), extend[:-1][same].astype(np.int32)  # neighbours among suffixes with that byte before them
    spent = 0
    for _ in range(1, length):
        if not fresh.any() or not len(later):
            break
        marks = np.cumsum(fresh, dtype=np.int32)
        parted = marks[later] != marks[earlier]
        reached = to[parted]
        fresh = np.zeros(n, bool)
        fresh[reached] = True
        fresh &= ~settled
        settled |= fresh
        spent += len(reached)
        if 4 * spent > len(later):  # those that have parted have nothing more to settle
            stay = ~settled[to]
            later, earlier, to, spent = later[stay], earlier[stay], to[stay], 0
    return order, settled


def repeats(texts: list[bytes], order_key: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, start, stop) of the bytes covered by windows that start earlier elsewhere.

    ``order_key`` holds each segment's place, such that a window's is its segment's plus its offset.
    """
    size = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int((size + 1).sum()), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    inside = np.arange(len(symbols)) - at[owner]
    symbols[inside < size[owner]] = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    order, starts = window_classes(symbols, length)
    key = (order_key[owner] + inside)[order]
    whole = (inside + length <= size[owner])[order]
    key = np.where(whole, key, np.iinfo(np.int64).max)
    first = np.flatnonzero(starts)
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(key))))
    hit = np.zeros(len(symbols), bool)
    hit[order[whole & (key > least)]] = True
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length
    return list(zip(owner[lo].tolist(), (lo - at[owner[lo]]).tolist(), (hi - at[owner[lo]]).tolist(), strict=True))


def _version(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.where(F.length("text") > 0).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), _version(F.col("text")).alias("v"), "text")


def _settled_here(key: np.ndarray, mark: np.ndarray, d: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a chunk without repeats of a row, which of them equal an earlier one, and which stand in a row that occurs twice."""
    gone, repeat, twice = (np.zeros(len(key), bool) for _ in range(3))
    # few segments have an equal: they are found by one sort of their hashes, and only they are put in order
    by_mark = np.argsort(mark)
    near = mark[by_mark][1:] == mark[by_mark][:-1]
    few = np.unique(np.concatenate([by_mark[1:][near], by_mark[:-1][near]]))
    few = few[np.lexsort((place[few], d[few], size[few], mark[few], key[few]))]
    a, b = few[:-1], few[1:]
    same = (key[a] == key[b]) & (mark[a] == mark[b]) & (size[a] == size[b])
    gone[b[same]] = True
    row = same & (d[a] == d[b]) & (place[a] == place[b])
    repeat[b[row]] = True
    twice[a[row]] = True
    stay = np.flatnonzero(~repeat)
    return stay, gone[stay], twice[stay]


def _cut_up(length: int, gram: int):
    """Segments of all texts; one that equals an earlier one of its chunk has a key below zero of its own document's."""

    def run(batches):
        for batch in batches:
            d, v = batch["d"].to_numpy(), batch["v"].to_numpy()
            for lo, _, data, offsets in text_chunks(batch["text"]):
                for part, ends, row, at in _pieces(data, offsets, length):
                    start, stop, key, mark, again = segments(part, ends, length, gram)
                    own = lo + row[start]
                    ids, place, size = d[own], (v[own] << 32) | at[start], (stop - start).astype(np.int32)
                    stay, gone, twice = _settled_here(key, mark, ids, place, size)
                    key = np.where(gone, -1 - (mix64(ids[stay].view(np.uint64)) & _LOW48).astype(np.int64), key[stay])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, mark[stay], ids[stay], place[stay], size[stay], again[stay], twice)], names=["key", "mark", "d", "ord", "len", "again", "twice"])

    return run


def _recut(length: int, gram: int):
    """Segments of the wanted spans by minimisers of ``gram`` bytes; with ``gram`` as long as a window, each window alone."""

    def run(batches):
        for batch in batches:
            for i, spans in enumerate(batch["hard"].to_pylist()):
                text = batch["text"][i].as_py().encode()
                v, twice = batch["v"][i].as_py(), batch["twice"][i].as_py()
                for s in spans:
                    raw = np.frombuffer(text, np.uint8)[s["at"] : s["at"] + s["len"]]
                    if gram < length:
                        start, stop, key, mark, again = segments(raw, np.full(len(raw), len(raw)), length, gram)
                    else:
                        window = _grams(_prefix_sums(raw), length)
                        start, key, mark = np.arange(len(window)), (mix64(window) & _LOW48).astype(np.int64), mix64(window + np.uint64(length)).view(np.int64)
                        stop, again = start + length, np.zeros(len(window), bool)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays([pa.array(key ^ s["key"]), pa.array(mark), pa.array(np.full(n, batch["d"][i].as_py(), np.int64)), pa.array((v << 32) | (s["at"] + start)), pa.array((stop - start).astype(np.int32)), pa.array(again), pa.array(np.full(n, twice, bool))], names=["key", "mark", "d", "ord", "len", "again", "twice"])

    return run


def _fetch(batches):
    """Bytes of wanted segments."""
    for batch in batches:
        for i, spans in enumerate(batch["hard"].to_pylist()):
            text, v = batch["text"][i].as_py().encode(), batch["v"][i].as_py()
            d, at = np.full(len(spans), batch["d"][i].as_py(), np.int64), np.array([s["at"] for s in spans], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([s["key"] for s in spans], pa.int64()), pa.array(d), pa.array((v << 32) | at), pa.array([text[s["at"] : s["at"] + s["len"]] for s in spans], pa.binary())], names=["key", "d", "ord", "bytes"])


def _settle(length: int):
    """Repeats among segments that come sorted by key, in chunks of whole keys."""

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        d, place, texts = np.array(rows["d"], np.int64), np.array(rows["ord"], np.int64), rows["bytes"]
        # places in one number: documents in order, then the start in the text
        docs, rank = np.unique(np.stack([d, place >> 32], axis=1), axis=0, return_inverse=True)
        key = (rank.ravel().astype(np.int64) << 32) | (place & 0xFFFFFFFF)
        by = np.argsort(key)
        seen: dict[bytes, int] = {}
        kept, out = [], []
        for i in by.tolist():
            if seen.setdefault(texts[i], i) == i:
                kept.append(i)
            else:
                out.append((i, 0, len(texts[i])))  # equal to an earlier segment
        out += [(kept[k], a, b) for k, a, b in repeats([texts[i] for i in kept], key[kept], length)]
        i, a, b = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(place[i] + a), pa.array((b - a).astype(np.int32))], names=["d", "ord", "len"])

    def run(batches):
        rows: dict[str, list] = {"d": [], "ord": [], "bytes": []}
        size, last = 0, None
        for batch in batches:
            for key, d, place, text in zip(batch["key"].to_pylist(), batch["d"].to_pylist(), batch["ord"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if size >= _CHUNK and key != last:
                    yield solve(rows)
                    rows, size = {"d": [], "ord": [], "bytes": []}, 0
                rows["d"].append(d)
                rows["ord"].append(place)
                rows["bytes"].append(text)
                size, last = size + len(text), key
        if rows["d"]:
            yield solve(rows)

    return run


def _merged(spans: list[dict]) -> np.ndarray:
    """Disjoint maximal [start, stop) runs covered by the spans."""
    x = np.array(sorted((s["at"], s["at"] + s["len"]) for s in spans), np.int64).reshape(-1, 2)
    stop = np.maximum.accumulate(x[:, 1])
    first = np.append(True, x[1:, 0] > stop[:-1])
    return np.stack([x[first, 0], stop[np.append(np.flatnonzero(first)[1:] - 1, len(x) - 1)]], axis=1)


def _small(df: DataFrame, spans: Column) -> DataFrame:
    n, m = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(spans), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and m <= BROADCAST_SPANS else df


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d, v, text, hard and twice of the documents with wanted spans; rows that repeat a document are one."""
    few = _small(wanted.select(F.col("d").alias("w_d"), F.col("v").alias("w_v"), "hard", "twice"), F.size("hard"))
    met = docs.join(few, (F.col("d") == F.col("w_d")) & (F.col("v") == F.col("w_v"))).select("d", "v", "text", "hard", "twice")
    if wanted.where("twice").limit(1).count():
        met = met.where("not twice").union(met.where("twice").dropDuplicates(["d", "v"]))
    return met


def _at() -> Column:
    return F.col("ord").bitwiseAND(F.lit((1 << 32) - 1))


def _by_document(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("d", F.shiftright("ord", 32).alias("v")).agg(F.collect_list(F.struct(_at().alias("at"), "len", "key")).alias("hard"), F.max("twice").alias("twice")))


def _refined(docs: DataFrame, wanted: DataFrame, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces of the wanted spans that repeat an earlier one; by document, first pieces to settle; and those of keys that stay hot."""
    pieces = cut(_texts(docs, wanted).mapInArrow(_recut(length, gram), "key long, mark long, d long, ord long, len int, again boolean, twice boolean"))
    firsts = cut(pieces.groupBy("key", "mark").agg(F.min(F.struct("d", "ord", "len", "again", "twice")).alias("f")).select("key", "f.*"))
    many = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > hot).select(F.col("key").alias("hot_key"))
    met = firsts.join(_small(many, F.lit(1)), F.col("key") == F.col("hot_key"), "left")
    few = met.where("hot_key is null").withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("kinds > 1 or again")
    return pieces.join(firsts, ["d", "ord", "key"], "left_anti"), _by_document(few), _by_document(met.where("hot_key is not null"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """d, v and runs (int64 pairs of start and stop) of each document with bytes to remove."""
    docs = _keyed(documents)
    cuts = docs.mapInArrow(_cut_up(length, GRAM), "key long, mark long, d long, ord long, len int, again boolean, twice boolean")
    by_mark = Window.partitionBy("key").orderBy("mark", "len", "d", "ord")
    whole = by_mark.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = F.col("key") < 0
    alike = lambda f: (f("mark").over(by_mark) == F.col("mark")) & (f("len").over(by_mark) == F.col("len"))
    # equal rows of a document give equal segments, next to each other: only one of them counts
    same = {way: F.coalesce(alike(f) & (f("d").over(by_mark) == F.col("d")) & (f("ord").over(by_mark) == F.col("ord")), F.lit(False)) for way, f in (("repeat", F.lag), ("next", F.lead))}
    told = cuts.select("key", "mark", "d", "ord", "len", "again", (~settled & ~F.coalesce(alike(F.lag), F.lit(False))).alias("first"), same["repeat"].alias("repeat"), (F.col("twice") | same["next"]).alias("twice"), F.count(F.lit(1)).over(whole).alias("held"), F.max("again").over(whole).alias("any_again"))
    told = told.where(settled | ((F.col("held") > 1) | F.col("any_again")) & ~F.col("repeat")).withColumn("kinds", F.sum(F.col("first").cast("int")).over(whole))
    kept = told.where("not first or kinds > 1 or again")
    span = F.struct(_at().alias("at"), "len")
    gone = F.when(~F.col("first"), span)
    hard, finer = (F.when(F.col("first") & x, F.struct(_at().alias("at"), "len", "key")) for x in (F.col("kinds") <= hot, F.col("kinds") > hot))
    per_doc = cut(kept.select("d", F.shiftright("ord", 32).alias("v"), gone.alias("gone"), hard.alias("hard"), finer.alias("finer"), "twice").groupBy("d", "v").agg(*[F.collect_list(c).alias(c) for c in ("gone", "hard", "finer")], F.max("twice").alias("twice")))
    wanted, repeated = [per_doc.where(F.size("hard") > 0).select("d", "v", "hard", "twice")], []
    left = per_doc.where(F.size("finer") > 0).select("d", "v", F.col("finer").alias("hard"), "twice")
    for gram in (FINE_GRAM, length):
        if not left.limit(1).count():
            break
        copies, few, left = _refined(docs, left, length, gram, hot)
        wanted.append(few)
        repeated.append(copies)
    fetched = reduce(DataFrame.union, [_texts(docs, w).mapInArrow(_fetch, "key long, d long, ord long, bytes binary") for w in wanted])
    found = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_settle(length), "d long, ord long, len int")
    more = reduce(DataFrame.union, [x.select("d", F.shiftright("ord", 32).alias("v"), span.alias("s")) for x in (found, *repeated)])
    spans = per_doc.select("d", "v", "gone").union(more.groupBy("d", "v").agg(F.collect_list("s").alias("gone"))).where(F.size("gone") > 0)

    def merge(batches):
        for batch in batches:
            runs = [_merged(x) for x in batch["gone"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["d"], batch["v"], pa.array([r.tobytes() for r in runs], pa.binary()), pa.array(np.array([len(r) for r in runs], np.int64))], names=["d", "v", "runs", "n"])

    return spans.groupBy("d", "v").agg(F.flatten(F.collect_list("gone")).alias("gone")).mapInArrow(merge, "d long, v long, runs binary, n long")


def strip_repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, the kept bytes (kept), n_bytes, n_removed and n_spans of every row."""
    runs = _small(cut(repeated_spans(documents, length, hot)).select(F.col("d").alias("r_d"), F.col("v").alias("r_v"), "runs", "n"), F.col("n"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = rows.join(runs, (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("r_d")) & (_version(F.col("text")) == F.col("r_v")), "left")
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def strip(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                out = []
                for text, raw in zip(part["text"].to_pylist(), part["runs"].to_pylist(), strict=True):
                    text = text.encode()
                    x = np.frombuffer(raw or b"", np.int64).reshape(-1, 2)
                    edges = [0, *x.ravel().tolist(), len(text)]
                    out.append((len(text), int((x[:, 1] - x[:, 0]).sum()), len(x), b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=schema.names)

    return met.select("doc_id", "text", "runs").mapInArrow(strip, schema)

