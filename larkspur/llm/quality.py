"""Quality rules with an isolation forest over rule statistics.

One pass takes each whole text's statistics: words, code points in words,
symbols, repeated lines and words inside repeated 8-word windows. Two plain
rules reject (too few words, too many repeated words). The forest then scores
the statistics as ratios, less their usual spread: anomalous texts are parted from the rest by few random
splits. What is usual is a median and a deviation of all rows that pass the plain
rules. The trees take ``SAMPLE`` rows each, drawn from at most ``fit_rows`` of them.
The threshold comes from all labelled rows, by a histogram of their scores: it lies
in a wide gap, with many low-quality rows and at most ``clean_loss`` of the good
ones (whose labels have errors of their own) beyond it.

Defined results: a null or empty text has zero for every statistic and fails the
base rule; a text of any length is counted whole; repeated rows get equal rows;
of labels that repeat an id the best counts; among equal thresholds the one in the
widest gap; without labelled rows, or when no threshold parts the labels, only the
base rules reject; an empty table gives no rows; columns other than doc_id and text
are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import IS_GAP, bounded_sample, cut, gram_hashes, mix64, span_hashes, spans, text_chunks

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
TREES, SAMPLE = 100, 256
FIT_ROWS = 8192
#: Steps of the histogram of labelled scores, which lie between 0 and 1.
STEPS = 4096
CLEAN_LOSS = 0.03
LOSS_WEIGHT = 10
SPREAD = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_AS_IS = np.arange(256, dtype=np.uint8)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over keys: equal to another of its row; equal to an earlier one of its row."""
    both = mix64(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def text_stats(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, row = spans(data, offsets)
    words = span_hashes(data, starts, ends, _AS_IS)
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": _per_row(~IS_GAP[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets),
    }
    ls, le, lrow = spans(data, offsets, _NEWLINE)
    in_line = np.concatenate([[0], np.cumsum(~IS_GAP[data], dtype=np.int64)])
    full = in_line[le] > in_line[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    out["n_dup_lines"] = np.bincount(lrow[_repeats(span_hashes(data, ls, le, _AS_IS), lrow)[1]], minlength=n)
    grams, first = gram_hashes(words, row, window)
    at = first[_repeats(grams, row[first])[0]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + window, len(words)), -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the five statistics of each text."""
    kind = documents.schema["doc_id"].dataType

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                got = text_stats(data, offsets)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *[pa.array(got[c].astype(np.int64)) for c in STATS]], names=["doc_id", *STATS])

    return documents.select("doc_id", "text").mapInArrow(count, T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in STATS]]))


def features(x: np.ndarray) -> np.ndarray:
    """Shape, not length: mean word length (drawn to 5 where words are few), share of symbols, and lines and words
    repeated beyond what a heading or a quotation explains."""
    n_words, chars, symbols, dup, rep = x.T.astype(float)
    return np.stack([(chars + 500) / (n_words + 100), np.sqrt(symbols / np.maximum(chars, 1)), np.maximum(dup - 2, 0) / (n_words + 50), np.maximum(rep / np.maximum(n_words, 1) - 0.2, 0)], axis=1)


def feature_columns() -> list[Column]:
    """``features`` as expressions."""
    n_words, chars, symbols, dup, rep = (F.col(c).cast("double") for c in STATS)
    least = lambda x: F.greatest(x, F.lit(1.0))
    return [(chars + 500) / (n_words + 100), F.sqrt(symbols / least(chars)), F.greatest(dup - 2, F.lit(0.0)) / (n_words + 50), F.greatest(rep / least(n_words) - 0.2, F.lit(0.0))]


class Usual:
    """What is usual of each feature: within ``SPREAD`` robust deviations of the median of all rows."""

    def __init__(self, stats: DataFrame, spread: float = SPREAD):
        middle = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(10000))
        columns = feature_columns()
        self.middle = np.array(list(stats.agg(*[middle(c) for c in columns]).first()), float)
        away = stats.agg(*[middle(F.abs(c - float(m))) for c, m in zip(columns, self.middle, strict=True)]).first()
        self.reach = spread * 1.4826 * np.array(list(away), float)

    def beyond(self, x: np.ndarray) -> np.ndarray:
        """How far features lie outside of that, so that ordinary variety parts nothing."""
        off = x - self.middle
        return np.sign(off) * np.maximum(np.abs(off) - self.reach, 0)


class IsolationForest:
    """Random axis splits on subsamples; ``score`` is 2 ** (-mean path / expected path), higher is odder."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        size = 2 ** (self.depth + 1)
        self.split = np.full((trees, size), -1, np.int64)
        self.at = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for t in range(trees):
            self._grow(rng, t, 1, 0, x[rng.choice(len(x), self.sample, replace=False)])

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rng, t: int, node: int, depth: int, x: np.ndarray) -> None:
        lo, hi = x.min(axis=0), x.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth == self.depth or len(x) < 2 or not len(free):
            self.path[t, node] = depth + self.expected(len(x))
            return
        f = rng.choice(free)
        cut_at = rng.uniform(lo[f], hi[f])
        self.split[t, node], self.at[t, node] = f, cut_at
        left = x[:, f] <= cut_at
        self._grow(rng, t, 2 * node, depth + 1, x[left])
        self._grow(rng, t, 2 * node + 1, depth + 1, x[~left])

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.split)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = self.split[t, node]
                go = f >= 0
                node = np.where(go, 2 * node + (x[rows, np.maximum(f, 0)] > self.at[t, node]), node)
            total += self.path[t, node]
        return 2.0 ** (-(total / len(self.split)) / max(self.expected(self.sample), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """From how many good and bad rows have each of some scores in order.

    Where the share of bad rows beyond exceeds ``LOSS_WEIGHT`` times that of good ones
    the most; in the middle of the widest gap among equal choices; infinite if more
    than ``clean_loss`` of the good rows would go or nothing is gained.
    """
    if not good.sum() or not bad.sum():
        return np.inf
    good_beyond, bad_beyond = good.sum() - np.cumsum(good), bad.sum() - np.cumsum(bad)
    gap = np.append(np.diff(scores), 0.0)
    gain = bad_beyond / bad.sum() - LOSS_WEIGHT * good_beyond / good.sum()
    gain[(good_beyond > clean_loss * good.sum()) | (gap <= 0)] = -np.inf
    best = gain.max()
    if best <= 0:
        return np.inf
    i = max(np.flatnonzero(gain >= best - 0.01), key=lambda k: gap[k])
    return float(scores[i] + gap[i] / 2)


def judge(documents: DataFrame, labels: DataFrame, min_words: int = 20, repeat_percent: int = 30, fit_rows: int = FIT_ROWS, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept, for every row."""
    stats = cut(statistics(documents))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    passed = stats.where(~F.col("base_failed"))
    rows = bounded_sample(passed, fit_rows, "doc_id", *STATS).select(*STATS).collect()
    forest, usual, limit = None, None, np.inf
    if len(rows) >= 2:
        usual = Usual(passed)
        forest = IsolationForest(usual.beyond(features(np.array(rows))))
    shared = documents.sparkSession.sparkContext.broadcast((forest, usual))

    def scored(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("anomaly", T.DoubleType())])

        def score(batches):
            model, ordinary = shared.value
            for batch in batches:
                x = np.stack([batch[c].to_numpy() for c in STATS], axis=1)
                got = model.score(ordinary.beyond(features(x))) if model is not None and len(x) else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=schema.names)

        return rows.mapInArrow(score, schema)

    if forest is not None:
        marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
        known = scored(passed.join(marks, "doc_id"))
        steps = known.groupBy(F.round(F.col("anomaly") * STEPS).cast("int").alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        steps = sorted(steps.collect())  # at most STEPS rows
        if steps:
            step, good, bad = (np.array(x) for x in zip(*steps, strict=True))
            limit = threshold(step / STEPS, good, bad, clean_loss)
    return scored(stats).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(float(limit))))
