"""Language ID by nearest centroid over normalised TF-IDF byte n-gram vectors.

Texts become hashed counts of 1- to 3-byte n-grams (letters lower-cased, other
ASCII runs folded to a blank), weighted ``log(1 + tf) * idf`` and scaled to unit
length. Each language keeps several centroids found by spherical k-means; a text
takes the language of the nearest one by cosine. A text is rejected when its
cosine falls below a floor calibrated, per language and length, on the distances
of training rows that stayed out of k-means.

Defined results: null texts and texts without a letter give ``und`` with score
0 and count as rejected; repeated rows each get their own, equal, row; of equally
near centroids the first, by language, wins; a text of any length is counted whole,
in pieces; with no training rows every text is ``und``; an empty table gives no
rows. The fit reads at most ``fit_rows`` rows, every other step reads all rows and
whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from larkspur.llm._common import LOWER, text_chunks

DIMS = 4096
FIT_ROWS = 2400
CENTROIDS = 4
#: Different n-grams at which a text passes to the next length class, and how floors follow from rows kept out of k-means.
LENGTHS = (100, 400)
KEPT_OUT = 3
SLACK = (0.15, 0.4, 0.6)
QUANTILE = 0.02
#: Kept-out rows that a quantile needs; a length class with fewer takes that of all.
ENOUGH = 20

#: Bytes as n-grams see them: letters lower-cased, bytes of longer code points kept, all else blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row for each text of a chunk."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1) * DIMS)
    piece = 1 << 18
    for lo in range(0, len(data), piece):
        codes = _FOLD[data[lo : lo + piece + 2]].astype(np.uint32)
        own = min(piece, len(data) - lo)
        row = np.searchsorted(offsets[1:], np.arange(lo, lo + len(codes)), "right")
        gram = np.zeros(len(codes), np.uint32)
        for k in (1, 2, 3):
            m = min(own, len(codes) - k + 1)
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(257) + codes[k - 1 : k - 1 + m] + np.uint32(1) if k > 1 else codes[:m] + np.uint32(1)
            ok = row[:m] == row[k - 1 : k - 1 + m]
            if k > 1:  # runs of blanks carry nothing
                ok &= ~((codes[:m] == 32) & (codes[1 : 1 + m] == 32))
            slot = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            out += np.bincount(row[:m][ok] * DIMS + slot[ok], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """idf weights, centroids with their languages, and the rejection floors of each language.

    One row in ``KEPT_OUT`` of each language stays out of k-means. A language's floor is
    a share of a low quantile of the cosines of such rows, for texts of each length class
    apart and with more room for short ones, which lie far from every centroid.
    """

    def __init__(self, counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS, slack: tuple[float, ...] = SLACK, quantile: float = QUANTILE):
        self.idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.1)
        self.langs = sorted(set(langs))
        size = length_class(counts)
        x, own = self.vectors(counts), np.array(langs)
        parts, owner, self.floor = [], [], np.zeros((len(self.langs), len(LENGTHS) + 1))
        for i, lang in enumerate(self.langs):
            mine, sizes = x[own == lang], size[own == lang]
            out = np.arange(len(mine)) % KEPT_OUT == KEPT_OUT - 1
            found = _kmeans(mine[~out], centroids)
            out = out if out.any() else ~out
            near = (mine[out] @ found.T).max(axis=1)
            for k in range(len(LENGTHS) + 1):
                part = near[sizes[out] == k]
                self.floor[i, k] = slack[k] * float(np.quantile(part if len(part) >= ENOUGH else near, quantile))
            parts.append(found)
            owner += [i] * len(found)
        self.centroids, self.owner = np.concatenate(parts), np.array(owner)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """``counts``: log(1 + tf)."""
        x = counts.astype(np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(axis=1)
        lang, score = self.owner[best], np.clip(near[np.arange(len(best)), best], 0, 1)
        return lang, score, score < self.floor[lang, length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    """0 for the shortest texts, by the number of different n-grams."""
    return np.searchsorted(LENGTHS, np.count_nonzero(counts, axis=1), "right")


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, seeded by farthest points."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.concatenate([centres, x[[(x @ centres.T).max(axis=1).argmin()]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit(documents: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model | None:
    """Fit on at most ``fit_rows`` rows with a text and a language, spread evenly over the languages.

    One scan counts the languages, a second draws the rows, by a hash below a threshold for each language.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = (rows.where(where) if where is not None else rows).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_rows)
    langs = counts.collect()  # at most fit_rows rows
    if not langs:
        return None
    each = max(1, fit_rows // len(langs))
    share = [(r["lang"], int((1 << 30) * (1.0 if r["count"] <= 2 * each else 1.5 * each / r["count"]))) for r in langs]
    wanted = F.broadcast(documents.sparkSession.createDataFrame(share, "lang string, below long"))
    drawn = rows.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text")).join(wanted, "lang").where("pmod(h, 1 << 30) < below")
    # about 1.5 times ``each`` rows of a language, twice at most where it is rare
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    picked = drawn.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= each).select("lang", "text")

    def featurise(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                counts = np.log1p(gram_counts(data, offsets)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(lo, hi - lo), pa.array([r.tobytes() for r in counts], pa.binary())], ["lang", "counts"])

    got = sorted(picked.mapInArrow(featurise, "lang string, counts binary").collect())
    return Model(np.frombuffer(b"".join(r.counts for r in got), np.float16).reshape(len(got), DIMS), [r.lang for r in got], centroids)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``documents`` plus lang_pred, score and rejected; only the text is read for them.

    A row travels in one column, so none of its names can clash; input columns named
    as the new ones are replaced.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score", "rejected")]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    lettered = F.coalesce(F.col("row")["text"].rlike("\\p{L}"), F.lit(False))
    back = [F.col("row")[c].alias(c) for c in kept]
    if model is None:
        return rows.select(*back, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["row"]]).add("lang", StringType()).add("near", DoubleType()).add("far", BooleanType())

    def predict(batches):
        m = shared.value
        names = np.array(m.langs, object)
        for batch in batches:
            lang, score, far = np.zeros(len(batch), int), np.zeros(len(batch)), np.zeros(len(batch), bool)
            for lo, hi, data, offsets in text_chunks(batch["row"].field(kept.index("text"))):
                lang[lo:hi], score[lo:hi], far[lo:hi] = m.predict(np.log1p(gram_counts(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(names[lang], pa.string()), pa.array(score), pa.array(far)], names=schema.names)

    return rows.mapInArrow(predict, schema).select(
        *back,
        F.when(lettered, F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(lettered, F.col("near")).otherwise(0.0).alias("score"),
        (~lettered | F.col("far")).alias("rejected"),
    )
