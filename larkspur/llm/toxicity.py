"""Toxicity by a convolutional text classifier trained in numpy.

Words are runs of letters, lower-cased. A word's embedding is the sum of the
rows of one hashed table for the word and for its first 4 and 6 bytes, so that
inflected and compounded forms share weight. Filters of widths 1, 2 and 3 run
over the words, are rectified and max-pooled over the whole text, and feed one
logistic unit. Embeddings start with each bucket's log-odds in one coordinate
and all weights are then trained with Adagrad through the argmax positions.

The decision threshold is calibrated by language: a hashed naive Bayes table,
learned from the same rows, guesses each text's language from its words, and the
threshold of that language, set on rows kept out of training, shifts the logit
so that 0.5 is the decision. Both labels are drawn alike, so an error of either kind
counts as many times as rows of its label stand for in the whole table. The
language column itself is never an input.

Defined results: texts that are null, empty or without letters get the score of
a text with no active filter; a text of any length is scored whole; of equally
likely languages the first counts; repeated rows get equal rows; repeated labels of
an id count once, toxic if any says so; without labels of both kinds every score is
0; an empty table gives no rows; other columns are not read, so none can clash.
The fit reads at most ``fit_rows`` labelled rows, of texts of at most ``fit_bytes``,
as bucket numbers that are made on the executors; every row is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._common import LOWER, bounded_sample, span_hashes, spans, text_chunks

BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
FIT_ROWS = 4000
FIT_BYTES = 1 << 16
EPOCHS = 6

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each distinct word of a chunk (word, then prefixes), the word of each place, and its text."""
    starts, ends, row = spans(data, offsets, _NO_LETTER)
    _, first, inverse = np.unique(span_hashes(data, starts, ends, LOWER), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    parts = [span_hashes(data, s, e, LOWER), *(span_hashes(data, s, np.minimum(e, s + k), LOWER) + np.uint64(k * 0x9E37) for k in PREFIXES)]
    return np.stack([(p % BUCKETS).astype(np.int64) for p in parts], axis=1) if len(s) else np.zeros((0, 1 + len(PREFIXES)), np.int64), inverse, row


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0, : FILTERS // 2] = np.abs(c[:, 0, : FILTERS // 2]) + 0.3 / len(c)
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out_bias = np.float32(-1.0)
        self.lang_names: list[str] = []
        self.lang_log = np.zeros((BUCKETS, 0), np.float32)
        self.lang_shift = np.zeros(0, np.float32)

    def pooled(self, buckets: np.ndarray, words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled pre-activations of each text (-inf without words) and where they come from."""
        best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.full(best.shape, -1, np.int64)
        if not len(words):
            return best, where
        vec = self.embed[buckets].sum(axis=1)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        owner, length = row[first], np.diff(np.append(first, len(row)))
        for i, (w, c) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            out = (vec @ c[0])[words]
            for j in range(1, w):
                step = (vec @ c[j])[words[j:]]
                step[row[j:] != row[:-j]] = 0  # past the end of the text
                out[:-j] += step
            top = np.maximum.reduceat(out, first, axis=0)
            hit = out == np.repeat(top, length, axis=0)
            place = np.where(hit, np.arange(len(words), dtype=np.int64)[:, None], len(words))
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best[owner, cols], where[owner, cols] = top, np.minimum.reduceat(place, first, axis=0)
        return best, where

    def logit(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def language(self, buckets: np.ndarray, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Index of the likeliest language of each text."""
        sums = np.zeros((n, self.lang_log.shape[1]))
        if len(words):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sums[row[first]] = np.add.reduceat(self.lang_log[buckets[:, 0]][words], first, axis=0)
        return sums.argmax(axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        buckets, words, row = word_buckets(data, offsets)
        z = self.logit(self.pooled(buckets, words, row, n)[0])
        if len(self.lang_shift):
            z = z - self.lang_shift[self.language(buckets, words, row, n)]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -50, 50)))


#: What is known of a text for training: the buckets of its different words, and the word at each place.
Text = tuple[np.ndarray, np.ndarray]


def _together(texts: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as ``word_buckets`` gives them for a chunk, but that each has words of its own."""
    size = np.array([len(b) for b, _ in texts], np.int64)
    at = np.cumsum(size) - size
    words = [w + a for (_, w), a in zip(texts, at, strict=True)]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    return np.concatenate([b for b, _ in texts]), np.concatenate(words), row


def featurised(rows: DataFrame) -> DataFrame:
    """The rows without their text, and the buckets of its words in their place."""
    keep = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("buckets", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                buckets, words, row = word_buckets(data, offsets)
                bound, made = np.searchsorted(row, np.arange(hi - lo + 1)), []
                for i in range(hi - lo):
                    own, at = np.unique(words[bound[i] : bound[i + 1]], return_inverse=True)
                    made.append((buckets[own].astype(np.int32).tobytes(), at.astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in keep], *[pa.array(x, pa.binary()) for x in zip(*made, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(texts: list[Text], toxic: np.ndarray, langs: list[str | None], weight: tuple[float, float] = (1.0, 1.0), epochs: int = EPOCHS, rate: float = 0.1, seed: int = 5) -> Model:
    """Train on four fifths of the rows and set each language's threshold on the rest; ``weight`` is how many rows a clean and a toxic one stand for."""
    model, rng = Model(), np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    hold, rest = order[: len(order) // 5], order[len(order) // 5 :]
    batches = [(_together([texts[i] for i in rest[k : k + 64]]), toxic[rest[k : k + 64]].astype(np.float32), [langs[i] for i in rest[k : k + 64]]) for k in range(0, len(rest), 64)]

    seen = np.zeros((2, BUCKETS), np.float32)  # texts of each kind that hold each bucket
    model.lang_names = sorted({x for x in langs if x})
    tally = np.ones((BUCKETS, len(model.lang_names)), np.float32) * 0.5
    for (buckets, words, row), y, who in batches:
        pairs = np.unique(row * len(buckets) + words) if len(words) else np.zeros(0, np.int64)
        r, w = pairs // max(len(buckets), 1), pairs % max(len(buckets), 1)
        for k in range(1 + len(PREFIXES)):
            b = np.unique(np.stack([r, buckets[w, k]]), axis=1)
            np.add.at(seen, (y[b[0]].astype(int), b[1]), 1)
        own = np.array([model.lang_names.index(x) if x else -1 for x in who])[r]
        np.add.at(tally, (buckets[w, 0][own >= 0], own[own >= 0]), 1)
    model.lang_log = np.log(tally / tally.sum(axis=0)).astype(np.float32)
    pos, neg = max(toxic[rest].sum(), 1), max((1 - toxic[rest]).sum(), 1)
    odds = np.log((seen[1] + 0.5) / (pos + 1)) - np.log((seen[0] + 0.5) / (neg + 1))
    weight = np.minimum(1, (seen[0] + seen[1]) / 8)
    model.embed[:, 0] = np.where(seen.sum(axis=0) > 0, odds * weight / 3, 0)

    state = {k: 1e-2 for k in ("out", "bias", "ob")}
    g_embed = np.full(model.embed.shape, 1e-2, np.float32)
    g_conv = [np.full(c.shape, 1e-2, np.float32) for c in model.conv]
    scale = np.float32(neg / pos) ** np.float32(0.5)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            (buckets, words, row), y, _ = batches[k]
            best, where = model.pooled(buckets, words, row, len(y))
            act = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
            dz = (p - y) * np.where(y > 0, scale, 1) / len(y)
            d_act = np.where((act > 0) & (where >= 0), dz[:, None] * model.out, 0).astype(np.float32)
            d_out, d_bias = act.T @ dz, d_act.sum(axis=0)
            for name, value in (("out", d_out), ("bias", d_bias), ("ob", np.array(dz.sum()))):
                state[name] = state[name] + value**2
            model.out -= (rate * d_out / np.sqrt(state["out"])).astype(np.float32)
            model.bias -= (rate * d_bias / np.sqrt(state["bias"])).astype(np.float32)
            model.out_bias -= np.float32(rate * dz.sum() / np.sqrt(state["ob"]))
            for i, w in enumerate(WIDTHS):
                r, f = np.nonzero(d_act[:, i * FILTERS : (i + 1) * FILTERS])
                at, g = where[r, i * FILTERS + f], d_act[r, i * FILTERS + f]
                for j in range(w):
                    there = at + j
                    ok = (there < len(row)) & (row[np.minimum(there, len(row) - 1)] == r)
                    b = buckets[words[there[ok]]]
                    vec, d_conv = model.embed[b].sum(axis=1), np.zeros((DIM, FILTERS), np.float32)
                    np.add.at(d_conv.T, f[ok], g[ok, None] * vec)
                    d_vec = g[ok, None] * model.conv[i][j].T[f[ok]]
                    g_conv[i][j] += d_conv**2
                    model.conv[i][j] -= rate * d_conv / np.sqrt(g_conv[i][j])
                    hit, inv = np.unique(b, return_inverse=True)
                    d = np.zeros((len(hit), DIM), np.float32)
                    np.add.at(d, inv.reshape(b.shape), d_vec[:, None, :])
                    g_embed[hit] += d**2
                    model.embed[hit] -= 0.3 * rate * d / np.sqrt(g_embed[hit])

    z, own = np.zeros(len(hold)), np.zeros(len(hold), int)
    for k in range(0, len(hold), 64):
        part = hold[k : k + 64]
        found = _together([texts[i] for i in part])
        z[k : k + 64] = model.logit(model.pooled(*found, len(part))[0])
        own[k : k + 64] = model.language(*found, len(part)) if model.lang_names else 0
    everyone = best_threshold(z, toxic[hold], 0.0, weight)
    model.lang_shift = np.array([best_threshold(z[own == i], toxic[hold][own == i], everyone, weight) for i in range(len(model.lang_names))], np.float32)
    return model


def best_threshold(z: np.ndarray, y: np.ndarray, default: float, weight: tuple[float, float] = (1.0, 1.0)) -> float:
    """The logit with the fewest errors, each counted by its label's weight, in the middle of the widest gap among equals; ``default`` for one kind only."""
    if y.sum() < 3 or (1 - y).sum() < 3:
        return default
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = weight[1] * np.cumsum(y) + weight[0] * ((1 - y).sum() - np.cumsum(1 - y))
    gap = np.append(np.diff(z), 0)
    errors = np.where(gap > 1e-6, errors, np.inf)
    i = max(np.flatnonzero(errors <= errors.min() * (1 + 1e-9)), key=lambda k: gap[k])
    return float(z[i] + gap[i] / 2)


def fit(documents: DataFrame, labels: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """Fit on at most ``fit_rows`` labelled rows, as even between the labels as they allow, of texts of at most ``fit_bytes``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = (known.where(where) if where is not None else known).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    half = fit_rows // 2
    picked = bounded_sample(known.where("toxic = 1"), half, "doc_id").unionByName(bounded_sample(known.where("toxic = 0"), half, "doc_id"))
    # at most fit_rows ids, so the documents need no shuffle
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.octet_length("text") <= fit_bytes)
    rows = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * fit_rows)
    rows = sorted(featurised(rows).collect(), key=lambda r: (r["doc_id"], r["words"], r["buckets"]))
    toxic = np.array([r["toxic"] for r in rows])
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    texts = [(np.frombuffer(r["buckets"], np.int32).reshape(-1, 1 + len(PREFIXES)).astype(np.int64), np.frombuffer(r["words"], np.int32).astype(np.int64)) for r in rows]
    return train(texts, toxic, [r["lang"] for r in rows], (total[0] / (toxic == 0).sum(), total[1] / toxic.sum()))


def rate(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted for every row; only the text is read for them."""
    if model is None:
        return documents.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def score(batches):
        m = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                out[lo:hi] = m.score(data, offsets)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
