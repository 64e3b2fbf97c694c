"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

The filter holds the unigrams and bigrams of all training rows. A count is stored
as its class: itself up to 46, then one class for each step of 1/46, so a class
tells a count to about one part in a hundred. Each class up to an n-gram's own is
an entry, so repeated membership probes, by doubling and halving, give the class
back. N-grams are dealt by hash to groups of about ``GROUP_BYTES`` of text; each
group's part of the filter is as large as its entries need to fill it by half.
No count is left out at any size.

A word's probability is ``P(w|h) = (c(h,w) + k P(w)) / (c(h) + k + f)`` with ``P(w)
= (c(w) + 0.5) / (C + 0.5 (V + 1))``: the counts are what the probes give, C is
the sum of the c(w), and one share is left for all unknown words. First classes
are checked by ``log2(V)`` probes, so that f, the number of the V words that an
entry is wrongly found for, is at most 1; sums over the vocabulary are within two
parts in a hundred of 1 (tested).

A filter of at most ``max_bytes`` is broadcast. A larger one stays a table of
groups: the most frequent n-grams, at most ``HEAD_WORDS`` and ``HEAD_PAIRS``, are
broadcast with their classes, and the others meet their group in a shuffle join,
which sends back sums for each text. Results are the same, to single precision.

Beside it stands the exact additive unigram score, from the exact counts that
travel with the groups.

Defined results: a null or empty text is its end token alone; repeated rows get
equal rows; a text of any length is scored whole; without training rows N = V = 0
and every token has the base's probability of an unseen one; an empty table gives
no rows; columns other than doc_id, text and those of ``held_out`` are not read,
so none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm._common import cut, mix64, span_hashes, spans, text_chunks

#: Filters of at most so many bytes, with the exact counts of their words, are broadcast whole.
MAX_BYTES = 1 << 24
#: Of a larger one the most frequent n-grams: 18 bytes for each word and 10 for each pair, 58 MB at most.
HEAD_WORDS = 1 << 20
HEAD_PAIRS = 1 << 22
#: Training text behind a group of n-grams, and the least number of groups.
GROUP_BYTES = 1 << 24
GROUPS = 16
#: Texts whose n-grams are asked for together.
ASK_BYTES = 1 << 22
ASK_DOCS = 4096
#: Counts up to this one have a class of their own.
EXACT = 46
#: Probes for each class beyond the first.
MORE_PROBES = 8
PRIOR = 256.0
#: The mass of counts is summed in such parts, so that it does not depend on the order.
MASS = 1 << 12
_FLUSH = 4_000_000

END = np.uint64(0xE4D0_0000_0000_00E5)
_UNI = np.uint64(0xA24BAED4963EE407)
_LOW48 = np.uint64((1 << 48) - 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk with each text's end token, the token before each, and the offsets of the texts' tokens."""
    n = len(offsets) - 1
    starts, ends, row = spans(data, offsets)
    bound = np.searchsorted(row, np.arange(n + 1)) + np.arange(n + 1)
    out = np.full(int(bound[-1]), END, np.uint64)
    if len(starts):
        out[np.arange(len(starts)) + row] = span_hashes(data, starts, ends)
    return out, np.append(END, out[:-1]), bound


def bigram_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9FB21C651E98DF25) + mix64(words))


def word_low(words: np.ndarray) -> np.ndarray:
    """What the filter knows a word by within its group."""
    return mix64(words ^ _UNI) & _LOW48


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each 64-bit key, by its high bits, so that keys in order are in order of groups."""
    return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def class_of(counts: np.ndarray) -> np.ndarray:
    counts = np.asarray(counts, np.int64)
    return np.where(counts <= EXACT, counts, EXACT + np.ceil(EXACT * np.log(np.maximum(counts, 1) / EXACT))).astype(np.int64)


def quantised(level: np.ndarray) -> np.ndarray:
    """The count a class stands for."""
    return np.where(level <= EXACT, level, EXACT * np.exp((level - EXACT - 0.5) / EXACT))


def count_unique(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _starts(group: np.ndarray) -> np.ndarray:
    """Where each run of equal groups begins."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)


def _six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel()


def _in_order(low: np.ndarray) -> bytes:
    """Sorted 48-bit keys: how many have each value of the first bytes, then the other bytes of each."""
    d = 2 if len(low) >= 1 << 17 else 1 if len(low) >= 1 << 11 else 0
    head = np.bincount((low >> np.uint64(48 - 8 * d)).astype(np.int64), minlength=256**d).astype(np.uint32) if d else np.zeros(0, np.uint32)
    return bytes([d]) + head.tobytes() + np.ascontiguousarray(low).view(np.uint8).reshape(-1, 8)[:, : 6 - d].tobytes()


def _from_order(raw) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8)
    d = int(raw[0])
    size = 4 * 256**d if d else 0
    rest = raw[1 + size :].reshape(-1, 6 - d)
    wide = np.zeros((len(rest), 8), np.uint8)
    wide[:, : 6 - d] = rest
    low = wide.view(np.uint64).ravel()
    if d:
        low |= np.repeat(np.arange(256**d, dtype=np.uint64), np.frombuffer(raw[1 : 1 + size].tobytes(), np.uint32)) << np.uint64(48 - 8 * d)
    return low


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All arrays of a column of bytes, one after the other; nulls are empty."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), kind)


_COUNTED = "group int, words binary, times binary, once binary, more binary, counts binary"


def _counted(group: int, words: np.ndarray, times: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> dict:
    """Counts of the n-grams of one group; most pairs occur once and need no number."""
    low = pairs & _LOW48
    order = np.argsort(low)
    low, counts = low[order], counts[order]
    once = counts == 1
    return {"group": group, "words": words.tobytes(), "times": times.astype(np.int64).tobytes(), "once": _in_order(low[once]), "more": _in_order(low[~once]), "counts": counts[~once].astype(np.int64).tobytes()}


def _pair_counts(once: list, more: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    once, more = [_from_order(x) for x in once], [_from_order(x) for x in more]
    return np.concatenate([*once, *more]), np.concatenate([np.ones(sum(map(len, once)), np.int64), *[np.frombuffer(x, np.int64) for x in counts]])


def counted_groups(train: DataFrame, groups: int) -> DataFrame:
    """A row for each group: exact counts of its words and pairs, and what the size of its filter follows from."""

    def count(batches):
        words, pairs, size = [], [], 0

        def drained():
            (w, t), (p, c) = (count_unique(x := np.concatenate(got), np.ones(len(x), np.int64)) for got in (words, pairs))
            own, at = group_of(w, groups), group_of(p, groups)
            for g in np.unique(np.concatenate([own, at])).tolist():
                i, j = (slice(*np.searchsorted(x, [g, g + 1])) for x in (own, at))
                yield pa.RecordBatch.from_pylist([_counted(g, w[i], t[i], p[j], c[j])], schema)

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch["text"]):
                w, before, _ = tokens(data, offsets)
                words.append(w)
                pairs.append(bigram_key(before, w))
                size += len(w)
                if size >= _FLUSH:
                    yield from drained()
                    words, pairs, size = [], [], 0
        if size:
            yield from drained()

    schema = to_arrow_schema(_COUNTED)

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words, times = count_unique(_joined(rows["words"], np.uint64), _joined(rows["times"], np.int64))
        pairs, counts = count_unique(*_pair_counts(*(rows[c].to_pylist() for c in ("once", "more", "counts"))))
        level = np.concatenate([class_of(times), class_of(counts)])
        facts = {"n": int(times.sum()), "distinct": len(times), "mass": int(np.rint(quantised(class_of(times)) * MASS).sum()), "first": len(level), "later": int(level.sum()) - len(level)}
        above = {f"{k}_above": [int((x >= 2**j).sum()) for j in range(48)] for k, x in (("words", times), ("pairs", counts))}
        return pa.Table.from_pylist([_counted(key[0].as_py(), words, times, pairs, counts) | facts | above], out)

    kind = _COUNTED + ", n long, distinct long, mass long, first long, later long, words_above array<long>, pairs_above array<long>"
    out = to_arrow_schema(kind)
    return train.select("text").mapInArrow(count, _COUNTED).groupBy("group").applyInArrow(merge, kind)


def to_arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(ddl)])


class Filter:
    """The bits of one or more groups end to end."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, probes: int):
        self.bits, self.sizes, self.probes = bits, sizes.astype(np.uint64), probes
        self.base = np.cumsum(sizes) - sizes

    @staticmethod
    def size_for(first, later, probes: int):
        """Bits that ``first`` first and ``later`` later classes fill by half, in whole bytes."""
        return (first * probes + later * MORE_PROBES) * 13 // 72 * 8 + 64  # 13/9 is 1 / ln 2

    @staticmethod
    def places(low: np.ndarray, level: np.ndarray, k: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two of the bits of each (n-gram, class)."""
        h = mix64(low * np.uint64(2) + np.uint64(1) + mix64(level.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(k)))
        return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), ((h & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)).astype(np.int64)

    @classmethod
    def built(cls, low: np.ndarray, level: np.ndarray, probes: int) -> Filter:
        size = cls.size_for(len(low), int(level.sum()) - len(low), probes)
        bits, m = np.zeros(size, bool), np.uint64(size)
        order = np.argsort(-level, kind="stable")
        low, level = low[order], level[order]
        for q in range(1, int(level[0]) + 1 if len(level) else 1):
            own = low[: np.searchsorted(-level, -q, "right")]
            for k in range((probes if q == 1 else MORE_PROBES) // 2):
                for at in cls.places(own, np.array([q]), k, m):
                    bits[at] = True
        return cls(np.packbits(bits, bitorder="little"), np.array([size]), probes)

    def has(self, group: np.ndarray, low: np.ndarray, level: np.ndarray, probes: int) -> np.ndarray:
        """Which (n-gram, class) entries all probes find."""
        left = np.arange(len(low))
        for k in range(probes // 2):
            size, base = self.sizes[group[left]], self.base[group[left]]
            ok = np.ones(len(left), bool)
            for at in self.places(low[left], level[left], k, size):
                at += base
                ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[ok]
            if not len(left):
                break
        out = np.zeros(len(low), bool)
        out[left] = True
        return out

    def read(self, group: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The class of each n-gram, 0 for one that is not there."""
        out = self.has(group, low, np.ones(len(low), np.int64), self.probes).astype(np.int64)

        def reach(left: np.ndarray, level: np.ndarray) -> np.ndarray:
            """Whether classes further on are there, and the class before each: one false entry alone leads one class too far at most."""
            hit = self.has(group[left], low[left], level, MORE_PROBES)
            again = np.flatnonzero(hit & (level > out[left] + 1))
            hit[again] = self.has(group[left[again]], low[left[again]], level[again] - 1, MORE_PROBES)
            return hit

        left = np.flatnonzero(out)
        fail, step = np.zeros(len(low), np.int64), 1
        while len(left):  # classes twice as far each time, until one is not there
            hit = reach(left, out[left] + step)
            fail[left[~hit]] = out[left[~hit]] + step
            left = left[hit]
            out[left] += step
            step *= 2
        while len(left := np.flatnonzero(fail - out > 1)):
            mid = (out[left] + fail[left]) // 2
            hit = reach(left, mid)
            out[left[hit]] = mid[hit]
            fail[left[~hit]] = mid[~hit]
        return out


class Scorer:
    """The numbers of the whole corpus, and probabilities from counts."""

    def __init__(self, n: int, v: int, mass: float, prior: float, probes: int):
        self.prior, self.false = prior, v * 2.0**-probes
        self.base_total, self.total = n + 0.5 * (v + 1), mass + 0.5 * (v + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.base_total)

    def weight(self, level: np.ndarray) -> np.ndarray:
        """k P(w) of words."""
        return self.prior * (quantised(level) + 0.5) / self.total

    def alone(self, level: np.ndarray) -> np.ndarray:
        """A token's share in its text's score as a word without known pairs, and as the context of the next one."""
        return np.log10(self.weight(level)) - np.log10(quantised(level) + self.prior + self.false)

    def paired(self, weight: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """What a known pair adds to that."""
        return np.log10(1 + quantised(pair) / weight)


class Head:
    """Values of the most frequent keys, found by the high bits of a key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]
        self.shift = np.uint64(63 - max(len(keys), 1).bit_length())
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not among them."""
        slot = keys >> self.shift
        at, stop = self.first[slot], self.first[slot + np.uint64(1)]
        out, left = np.full(len(keys), -1, np.int64), np.flatnonzero(at < stop)
        at, stop, keys = at[left], stop[left], keys[left]
        while len(left):
            hit = self.keys[at] == keys
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < stop)
            left, at, stop, keys = left[on], at[on] + 1, stop[on], keys[on]
        return out


def _group_filter(row: dict, probes: int) -> tuple[Filter, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The filter of a row of ``counted_groups``, and its exact words, times, pairs and counts."""
    words, times = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["times"], np.int64)
    pairs, counts = _pair_counts([row["once"]], [row["more"]], [row["counts"]])
    return Filter.built(np.concatenate([word_low(words), pairs]), np.concatenate([class_of(times), class_of(counts)]), probes), words, times, pairs, counts


def filters(counted: DataFrame, probes: int) -> DataFrame:
    """group, its bits, and the exact counts of its words."""

    def build(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made, words, times, *_ = _group_filter(row, probes)
                yield pa.RecordBatch.from_pylist([{"group": row["group"], "bits": made.bits.tobytes(), "words": words.tobytes(), "times": times.tobytes()}], schema)

    kind = "group int, bits binary, words binary, times binary"
    schema = to_arrow_schema(kind)
    return counted.select(*_COUNTED.replace(" int", "").replace(" binary", "").split(", ")).mapInArrow(build, kind)


def heads(counted: DataFrame, probes: int, least_word: int, least_pair: int) -> tuple[Head, Head]:
    """Words and pairs with so many occurrences: the class that the filter gives, and for words the exact count."""

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made, words, times, pairs, counts = _group_filter(row, probes)
                w, p = times >= least_word, counts >= least_pair
                level = [made.read(np.zeros(len(x), np.int64), x).astype(np.uint16).tobytes() for x in (word_low(words[w]), pairs[p])]
                yield pa.RecordBatch.from_pylist([{"group": row["group"], "words": words[w].tobytes(), "times": times[w].tobytes(), "levels": level[0], "pairs": _six(pairs[p]), "pair_levels": level[1]}], schema)

    kind = "group int, words binary, times binary, levels binary, pairs binary, pair_levels binary"
    schema = to_arrow_schema(kind)
    got = counted.select(*_COUNTED.replace(" int", "").replace(" binary", "").split(", ")).mapInArrow(pick, kind).toArrow()  # bounded by HEAD_WORDS and HEAD_PAIRS
    pairs = [tagged(_from_six(x.as_buffer()), np.int64(g.as_py())) for g, x in zip(got["group"], got["pairs"], strict=True)]
    words = Head(_joined(got["words"], np.uint64), _joined(got["levels"], np.uint16), _joined(got["times"], np.int64))
    return words, Head(np.concatenate(pairs) if pairs else np.zeros(0, np.uint64), _joined(got["pair_levels"], np.uint16))


def tagged(low: np.ndarray, group) -> np.ndarray:
    """Pairs as their group and low 48 bits tell them, spread over 64 bits."""
    return mix64((low & _LOW48) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(group).astype(np.uint64))


def score(documents: DataFrame, held_out: Column, max_bytes: int = MAX_BYTES, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = documents.select("doc_id", "text", held_out.alias("held_out"))
    train = docs.where("not held_out")
    groups = max(GROUPS, -(-(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    counted = cut(counted_groups(train, groups))
    facts = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "distinct", "mass", "first", "later")]).first()
    probes = 2 * math.ceil(max(math.log2(max(facts["distinct"], 1)), MORE_PROBES) / 2)
    scorer = Scorer(facts["n"], facts["distinct"], facts["mass"] / MASS, prior, probes)
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    if Filter.size_for(facts["first"], facts["later"], probes) // 8 + 16 * facts["distinct"] <= max_bytes:
        return _by_broadcast(docs, filters(counted, probes), groups, scorer, probes, facts["n"], out)
    return _by_groups(docs, counted, groups, scorer, probes, facts["n"], out)


def _told(doc_id, held_out, n_tokens, known, n: int, base, score, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, held_out, pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(score)], names=names)


def _by_broadcast(docs: DataFrame, built: DataFrame, groups: int, scorer: Scorer, probes: int, n: int, out: T.StructType) -> DataFrame:
    """Every n-gram is looked up in the whole filter, which each worker has."""
    got = built.toArrow()  # max_bytes at most
    sizes = np.full(groups, 8, np.int64)
    parts = [b"\0"] * groups
    for g, b in zip(got["group"].to_pylist(), got["bits"].to_pylist(), strict=True):
        parts[g], sizes[g] = b, 8 * len(b)
    model = Filter(np.frombuffer(b"".join(parts), np.uint8), sizes, probes)
    shared = docs.sparkSession.sparkContext.broadcast((model, Head(_joined(got["words"], np.uint64), _joined(got["times"], np.int64))))

    def rate(batches):
        model, exact = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                words, before, bound = tokens(data, offsets)
                single, at = np.unique(words, return_inverse=True)
                pairs, at_pair = np.unique(bigram_key(before, words), return_inverse=True)
                level = model.read(group_of(single, groups), word_low(single))[at]
                pair = model.read(group_of(pairs, groups), pairs & _LOW48)[at_pair]
                place = exact.find(single)
                c = (np.where(place >= 0, exact.values[0][place], 0) if len(exact.keys) else np.zeros(len(single), np.int64))[at]
                own = scorer.alone(level) + scorer.paired(scorer.weight(level), pair)
                base, total, known = (np.add.reduceat(x, bound[:-1]) for x in (scorer.base(c), own, (c > 0).astype(np.int64)))
                yield _told(batch["doc_id"].slice(lo, hi - lo), batch["held_out"].slice(lo, hi - lo), np.diff(bound), known, n, base, total, out.names)

    return docs.mapInArrow(rate, out)


_ASKED = "chunk long, deal int, steps binary, weights binary, pairs binary, words binary, rare binary"
_MET = "chunk long, deal int, docs binary, sums binary, times binary, levels binary, rare binary"
_CARRIED = "carry struct<n_tokens:binary,known:binary,base:binary,score:binary,row:binary,at_word:binary,at_pair:binary,doc_id:array<{0}>,held_out:array<boolean>>"


def _steps(rows: np.ndarray) -> bytes:
    """Rows in order, each as its distance from the one before, in one byte or two."""
    step = np.diff(rows, prepend=0)
    return step.astype(np.uint8 if step.max() < 256 else np.uint16).tobytes()


def _by_groups(docs: DataFrame, counted: DataFrame, groups: int, scorer: Scorer, probes: int, n: int, out: T.StructType) -> DataFrame:
    """Frequent n-grams are looked up in the map; the others meet their group of the filter, dealt by hash.

    A chunk of texts asks each group once: for pairs of a frequent word, whose
    contributions come back as sums by text; for its rare words; and for the pairs of
    rare words. What is known of the chunk without those answers goes along.
    """
    rows = counted.select(F.posexplode(F.arrays_zip("words_above", "pairs_above")).alias("j", "x")).groupBy("j").agg(F.sum("x.words_above").alias("w"), F.sum("x.pairs_above").alias("p")).collect()  # 48 rows
    least_word = 2 ** min(r["j"] for r in rows if r["w"] <= HEAD_WORDS)
    # a frequent pair's word is frequent
    least_pair = max(2 ** min(r["j"] for r in rows if r["p"] <= HEAD_PAIRS), least_word)
    shared = docs.sparkSession.sparkContext.broadcast(heads(counted, probes, least_word, least_pair))
    carried = _CARRIED.format(docs.schema["doc_id"].dataType.simpleString())
    asked_kind, met_kind = f"{_ASKED}, {carried}", f"{_MET}, {carried}"
    asked_schema, met_schema = to_arrow_schema(asked_kind), to_arrow_schema(met_kind)
    small = np.uint16 if groups <= 1 << 16 else np.int32

    def ask(batches):
        top_words, top_pairs = shared.value
        level_w, times_w = top_words.values
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"], ASK_BYTES, ASK_DOCS):
                words, before, bound = tokens(data, offsets)
                row = np.repeat(np.arange(hi - lo), np.diff(bound))
                place = top_words.find(words)
                top = np.flatnonzero(place >= 0)
                level = level_w[place[top]].astype(np.int64)
                known = np.bincount(row[top], minlength=hi - lo)
                base = np.bincount(row[top], scorer.base(times_w)[place[top]], minlength=hi - lo)
                weight = scorer.weight(level)
                own = scorer.alone(level)
                keys = bigram_key(before, words)
                deal = group_of(keys, groups)
                pair = top_pairs.find(tagged(keys, deal))
                seen = pair[top] >= 0
                own[seen] += scorer.paired(weight[seen], top_pairs.values[0][pair[top[seen]]].astype(np.int64))
                total = np.bincount(row[top], own, minlength=hi - lo)
                asks: dict[int, dict] = {}

                def put(group: np.ndarray, name: str, values, asks=asks):
                    first = _starts(group)
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=False):  # nothing where there is no group
                        asks.setdefault(int(group[a]), {})[name] = values(slice(a, b))

                open_ = top[~seen]
                order = np.argsort(deal[open_].astype(small), kind="stable")
                open_, weight_o = open_[order], level[~seen][order].astype(np.uint16)
                g = deal[open_]
                put(g, "pairs", lambda s: _six(keys[open_[s]]))
                put(g, "weights", lambda s: weight_o[s].tobytes())
                put(g, "steps", lambda s: _steps(row[open_[s]]))
                rare = np.flatnonzero(place < 0)
                at_word, at_pair = group_of(words[rare], groups), deal[rare]
                for name, at, values in (("words", at_word, words[rare]), ("rare", at_pair, keys[rare])):
                    order = np.argsort(at.astype(small), kind="stable")
                    sorted_ = values[order]
                    put(at[order], name, (lambda s, x=sorted_: x[s].tobytes()) if name == "words" else (lambda s, x=sorted_: _six(x[s])))
                chunk = batch["row"][lo].as_py()  # the number of a chunk's first row is its own
                carry = {"n_tokens": np.diff(bound).astype(np.int64).tobytes(), "known": known.astype(np.int64).tobytes(), "base": base.tobytes(), "score": total.tobytes(), "row": row[rare].astype(np.uint16).tobytes(), "at_word": at_word.astype(small).tobytes(), "at_pair": at_pair.astype(small).tobytes(), "doc_id": batch["doc_id"].slice(lo, hi - lo).to_pylist(), "held_out": batch["held_out"].slice(lo, hi - lo).to_pylist()}
                found = [{"chunk": chunk, "deal": int(mix64(np.array([chunk], np.uint64))[0] % np.uint64(groups)), "carry": carry}]
                yield pa.RecordBatch.from_pylist(found + [{"chunk": chunk, "deal": k} | x for k, x in asks.items()], asked_schema)

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if len(right):
            bits = np.frombuffer(right["bits"][0].as_buffer(), np.uint8)
            words, times = np.frombuffer(right["words"][0].as_buffer(), np.uint64), np.frombuffer(right["times"][0].as_buffer(), np.int64)
        else:
            bits, words, times = np.zeros(1, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        model, exact, result = Filter(bits, np.array([8 * len(bits)]), probes), Head(words, times), []
        read = lambda low: model.read(np.zeros(len(low), np.int64), low)
        for row in left.to_pylist():
            met = {"chunk": row["chunk"], "deal": row["deal"], "carry": row["carry"]}
            if row["pairs"]:
                weight = scorer.weight(np.frombuffer(row["weights"], np.uint16).astype(np.int64))
                more = scorer.paired(weight, read(_from_six(row["pairs"])))
                docs_of = np.cumsum(np.frombuffer(row["steps"], np.uint8 if len(row["steps"]) == len(more) else np.uint16), dtype=np.int64)
                first = _starts(docs_of)
                met |= {"docs": docs_of[first].astype(np.uint16).tobytes(), "sums": np.add.reduceat(more, first).astype(np.float32).tobytes()}
            if row["words"]:
                asked = np.frombuffer(row["words"], np.uint64)
                place = exact.find(asked)
                met |= {"times": (np.where(place >= 0, exact.values[0][place], 0) if len(words) else np.zeros(len(asked), np.int64)).tobytes(), "levels": read(word_low(asked)).astype(np.uint16).tobytes()}
            if row["rare"]:
                met["rare"] = read(_from_six(row["rare"])).astype(np.uint16).tobytes()
            result.append(met)
        return pa.Table.from_pylist(result, met_schema)

    def finish(found: pa.Table) -> pa.Table:
        found = found.sort_by("deal")
        carry = next(x.as_py() for x in found["carry"] if x.is_valid)
        n_tokens, known = (np.frombuffer(carry[c], np.int64) for c in ("n_tokens", "known"))
        base, total = (np.frombuffer(carry[c], np.float64).copy() for c in ("base", "score"))
        for d, s in zip(found["docs"], found["sums"], strict=True):
            if d.is_valid:
                total[np.frombuffer(d.as_buffer(), np.uint16)] += np.frombuffer(s.as_buffer(), np.float32)
        row = np.frombuffer(carry["row"], np.uint16).astype(np.int64)
        c, level, pair = (np.zeros(len(row), np.int64) for _ in range(3))
        by_word, by_pair = (np.argsort(np.frombuffer(carry[x], small), kind="stable") for x in ("at_word", "at_pair"))
        c[by_word], level[by_word], pair[by_pair] = _joined(found["times"], np.int64), _joined(found["levels"], np.uint16), _joined(found["rare"], np.uint16)
        add = lambda x: np.bincount(row, x, minlength=len(base))
        base += add(scorer.base(c))
        total += add(scorer.alone(level) + scorer.paired(scorer.weight(level), pair))
        known = known + add(c > 0).astype(np.int64)
        ids = pa.array(carry["doc_id"], to_arrow_type(out["doc_id"].dataType))
        return pa.Table.from_batches([_told(ids, pa.array(carry["held_out"], pa.bool_()), n_tokens, known, n, base, total, out.names)])

    numbered = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text", "held_out")
    asked = numbered.mapInArrow(ask, asked_kind)
    table = filters(counted, probes).withColumnRenamed("group", "deal")
    met = asked.groupBy("deal").cogroup(table.groupBy("deal")).applyInArrow(meet, met_kind)
    return met.groupBy("chunk").applyInArrow(finish, out)
