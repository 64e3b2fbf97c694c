"""Best-fit packing of tokenised documents into sequences of bounded length.

Every document is tokenised whole, ended by one end token, and cut into pieces
only where it is longer than a sequence. Full pieces fill a sequence alone. The
others are dealt by hash into groups of about ``group_pieces`` and packed group
by group with best-fit decreasing: a segment tree over remaining capacities
finds the tightest open sequence that still holds a piece in logarithmic time.
A group's waste is about one sequence, so the number of sequences stays within
a few in 100,000 of a packing in one go, and no task holds more than a group.

Words between ASCII blanks are tokenised once per worker and kept in a bounded
cache, which goes when the worker is given texts for anything else; the tokenizer removes blanks and never joins what they part, so the ids
equal those of the whole text (tested). It also parts a full stop or comma from
an ASCII letter before it and lower-cases, so such a last character is a word of
its own, and words that differ in the case of ASCII letters share an entry.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each on its own; pieces of equal length go in order of id and place; a text
of any length is tokenised whole; an empty table gives no rows; columns other than
doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import KEPT, LOWER, cut, span_hashes, spans, text_chunks

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 1 << 17
_CACHE_WORDS = 1_500_000
_IDENTITY = np.arange(256, dtype=np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII blanks only: code points that a tokenizer may treat in another way stay inside words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


class WordTokens:
    """Token ids of whole texts, looked up word by word; the table is emptied when it is full."""

    #: A word of one token of its own, which parts the words that are encoded in one call.
    MARK = "~"

    def __init__(self, path: str, limit: int = _CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.kind = np.uint16 if max(tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        mark = self.encode([self.MARK], add_special_tokens=False)[0].ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.old = self.new = none  # hashes in order, places in the pool, numbers of ids; new words are merged now and then
        self.pool, self.used = np.zeros(1 << 20, self.kind), 0

    def encoded(self, words: list[str], block: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one word after the other, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(words), block):
            part = words[lo : lo + block]
            flat = np.array(self.encode([f" {self.MARK} ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(flat == self.mark)
            if len(marks) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(flat)]])) - 1)
                ids.append(np.delete(flat, marks))
            else:  # a word has the mark in it
                each = [x.ids for x in self.encode(part, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in each]))
                ids.append(np.array([i for x in each for i in x], np.uint32))
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        flat, size = self.encoded(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 4, self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.new = _merged(self.new, (keys, (self.used + np.cumsum(size) - size).astype(np.uint32), size.astype(np.uint32)))
        self.used += len(flat)
        if 4 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = _merged(self.old, self.new), tuple(x[:0] for x in self.new)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each word, -1 where it is unknown."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, places, sizes in (self.old, self.new):
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return at, size

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, without end tokens, and the offsets of each text's ids."""
        starts, ends, row = spans(data, offsets, _BLANK)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, row = _without_stops(data, starts, ends, row)
        keys = span_hashes(data, starts, ends, LOWER)
        special = np.unique(np.searchsorted(starts, np.flatnonzero(data == 60), "right") - 1)
        special = special[special >= 0]  # a special token's name counts only as it is written
        keys[special] = span_hashes(data, starts[special], ends[special], _IDENTITY) ^ np.uint64(0x5851F42D4C957F2D)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) > self.limit:
            self.clear()
        at, size = self.find(keys)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            raw = data.tobytes()
            self.learn(keys[unknown], [raw[starts[i] : ends[i]].decode() for i in first[unknown]])
            at, size = self.find(keys)
        at, size = at[inverse], size[inverse]
        ends_at = np.cumsum(size)
        ids = self.pool[np.arange(int(ends_at[-1])) + np.repeat(at - ends_at + size, size)]
        bound = np.searchsorted(row, np.arange(len(offsets)))
        return ids.astype(np.uint32), np.concatenate([[0], ends_at])[bound]


def _without_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part one last full stop or comma from each word that has an ASCII letter before it."""
    last = data[ends - 1]
    part = ((last == 46) | (last == 44)) & (ends - starts > 1)
    part[part] = _LETTER[data[ends[part] - 2]]
    times = 1 + part
    at = np.cumsum(times) - times
    s, e = np.repeat(starts, times), np.repeat(ends, times)
    stop = at[part] + 1
    s[stop] = ends[part] - 1
    e[stop - 1] -= 1
    return s, e, np.repeat(row, times)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables in order of their keys as one, with little more memory than the one takes."""
    at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
    first = np.ones(len(a[0]) + len(b[0]), bool)
    first[at] = False
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.empty(len(first), x.dtype)
        both[first], both[at] = x, y
        out.append(both)
    return tuple(out)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def cut_up(batches):
        words = KEPT.get(tokenizer) or KEPT.setdefault(tokenizer, WordTokens(tokenizer))
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"], keep=True):
                ids, bound = words.ids(data, offsets)
                out = []
                for i in range(hi - lo):
                    own = np.concatenate([ids[bound[i] : bound[i + 1]], end])
                    out += [(lo + i, k, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(own), capacity))]
                at, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(cut_up, schema)


class OpenBins:
    """Open sequences by remaining capacity, under a segment tree of which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, bin_id: int) -> None:
        self.bins[remaining].append(bin_id)
        node = self.leaves + remaining
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the (remaining, id) of the tightest bin with at least ``need`` left."""
        node, any_ = self.leaves + need, self.any
        while not any_[node]:  # up and right until some capacity >= need is open
            while node & 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if any_[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        found = self.bins[remaining].pop()
        if not self.bins[remaining]:
            any_[node] = 0
            while node > 1 and not (any_[node] or any_[node ^ 1]):
                node >>= 1
                any_[node] = 0
        return remaining, found


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset, open_, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenBins(capacity), 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        remaining, bin_id = open_.take(size) or (capacity, n)
        n += bin_id == n
        bins[i], offset[i] = bin_id, capacity - remaining
        if remaining > size:
            open_.put(remaining - size, bin_id)
    return bins, offset


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All columns of the pieces plus sequence_id and offset.

    The pieces are checkpointed once, since their number sets the number of groups.
    """
    kept = cut(cut_pieces)
    groups = max(1, -(-kept.count() // group_pieces))
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"), F.lit(groups)))
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        bins, offset = best_fit_decreasing(group["length"].to_numpy(), capacity)
        base = key[0].as_py() << 32
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(fill, schema)
