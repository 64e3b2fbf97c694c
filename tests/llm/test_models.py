"""Language ID, quality, toxicity, Bloom-filter scores and lattice links."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import bloom_lm, language_id, lattice_dedup, quality, toxicity
from larkspur.llm._common import remainder

from .helpers import SCHEMA, WORD, documents, empty, lowered, rows, words


def held(i, of, at):
    return i is not None and zlib.crc32(str(i).encode()) % of == at


# language ID


def test_language(spark):
    rng = random.Random(3)
    parts = {"aa": "sha sho shi tha tho", "bb": "éla ono rré qui ñu", "cc": "krz ptk wsz ghn dvr"}
    data = [(i, " ".join("".join(rng.choice(parts[k].split()) for _ in range(3)) for _ in range(rng.randint(4, 60))), k, "s", 1) for i, k in enumerate(list(parts) * 60)]
    data += [(900, None, "aa", "s", 1), (901, "", "aa", "s", 1), (902, "12 345 !?", "bb", "s", 1), (903, data[0][1] * 2000, None, None, 1), (None, data[1][1], None, None, 1)]
    docs = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "_lang", "_far", "row", "a.b")})
    model = language_id.fit(docs, remainder(4) != 2, fit_rows=90)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(data)
    out = [got[i].lang_pred == k for i, _, k, *_ in data[:180] if held(i, 4, 2)]
    assert sum(out) >= 0.97 * len(out)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {(r["_lang"], r["row"], r["a.b"]) for r in got.values()} == {("clash",) * 3}
    assert not any(got[i].rejected for i in range(180))
    for r in got.values():  # the same model by plain arithmetic on one text
        want = plain_cosine(model, next((t for i, t, *_ in data if i == r.doc_id), None))
        assert r.score == pytest.approx(want, abs=1e-4)


def plain_cosine(model, text):
    """The best cosine of a text with the centroids, n-gram by n-gram."""
    if not text or not any(c.isalpha() for c in text):
        return 0
    codes = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    counts = [0] * language_id.DIMS
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            if n > 1 and codes[i] == codes[i + 1] == 32:
                continue
            gram = 0
            for k, c in enumerate(codes[i : i + n]):
                gram = (gram * 257 + c + 1) % 2**32 if k else c + 1
            counts[(gram * 2654435761 % 2**32) >> 20] += 1
    x = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf, strict=True)]
    norm = math.sqrt(sum(v * v for v in x))
    return max(sum(v * float(c) for v, c in zip(x, centre, strict=True)) / norm for centre in model.centroids)


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, remainder(4) != 2)
    noise = [(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(60)), None, "s", 1) for i in range(20)]
    noise += [(100 + i, t * 3, None, "s", 1) for i, t in enumerate(["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια. ", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. "])]
    assert all(r.rejected for r in language_id.identify(spark.createDataFrame(noise, SCHEMA), model).collect())
    kept = language_id.identify(docs.where(remainder(4) == 2).where("text rlike '(\\\\p{L}+ ){8}'"), model).groupBy("rejected").count().collect()
    assert sum(r["count"] for r in kept if r["rejected"]) <= 0.005 * sum(r["count"] for r in kept)


def test_language_without_training_rows(spark):
    assert language_id.fit(empty(spark)) is None
    assert {r.lang_pred for r in language_id.identify(documents(spark), None).collect()} == {"und"}
    assert language_id.identify(empty(spark), None).collect() == []


def test_gram_counts_ignore_chunking():
    data = np.frombuffer(("abc Äb " * 60000).encode(), np.uint8)
    whole = language_id.gram_counts(data, np.array([0, len(data)]))
    half = len("abc Äb ".encode()) * 30000
    two = language_id.gram_counts(data, np.array([0, half, len(data)])).sum(axis=0)
    assert np.abs(whole[0] - two).sum() <= 4


# quality


def base(text, window=8):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    cover = set()
    for i in range(len(w) - window + 1):
        if seen[tuple(w[i : i + window])] > 1:
            cover |= set(range(i, i + window))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics(spark):
    data = [*rows(), (5000, "a b c d e f g h\na b c d e f g h\n#|é é\n", "en", "a", 1), (5001, "For " * 200, "en", "a", 1)]
    got = quality.judge(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = Counter((r[0], *base(r[1])) for r in data)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)  # no labels: only the base rules reject
    assert quality.judge(empty(spark), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_quality_drops_labelled_junk_only(spark):
    rng = random.Random(9)
    good = [(i, " ".join(words(rng, rng.randint(40, 200))), "en", "a", 1) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in words(rng, rng.randint(40, 200))), "en", "a", 1) for i in range(40)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in [*good, *junk] if r[0] % 2] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(good + junk, SCHEMA), labels).collect()}
    assert sum(got[r[0]] for r in good) >= 0.97 * len(good)
    assert sum(got[r[0]] for r in junk) <= 0.1 * len(junk)


def test_quality_threshold_counts_all_labelled_rows():
    scores, good, bad = np.array([0.3, 0.4, 0.6, 0.7]), np.array([50, 49, 1, 0]), np.array([1, 0, 3, 6])
    assert quality.threshold(scores, good, bad) == pytest.approx(0.5)
    assert quality.threshold(scores, good, bad, clean_loss=0.0) == pytest.approx(0.65)
    assert quality.threshold(scores, good, np.zeros(4, int)) == np.inf


def test_quality_features_alike_in_both_forms(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 400, (60, 5)), np.zeros((1, 5), int)])
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{c} long" for c in quality.STATS))
    assert np.allclose(np.array([list(r) for r in df.select(*quality.feature_columns()).collect()]), quality.features(x))
    usual = quality.Usual(df)
    middle = np.sort(quality.features(x), axis=0)[30]
    assert np.allclose(usual.middle, middle) and np.allclose(usual.reach, quality.SPREAD * 1.4826 * np.sort(np.abs(quality.features(x) - middle), axis=0)[30])


def test_forest_paths_by_recursion():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(500, 4)), rng.normal(6, 1, size=(5, 4))])
    forest = quality.IsolationForest(x, trees=20, sample=64)

    def path(t, node, row):
        f = forest.split[t, node]
        return forest.path[t, node] if f < 0 else path(t, 2 * node + int(row[f] > forest.at[t, node]), row)

    def expected(n):
        return 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n

    want = [2 ** (-np.mean([path(t, 1, row) for t in range(20)]) / expected(64)) for row in x]
    assert forest.score(x) == pytest.approx(want, abs=0.01)
    assert forest.score(x)[500:].min() > np.quantile(forest.score(x)[:500], 0.95)


# toxicity


def plain_toxicity(model, text):
    """The score of one text, word by word and filter by filter."""
    raw, words = (text or "").encode(), []
    for c in raw:
        letter = 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
        if letter and words and words[-1] is not None:
            words[-1] += bytes([c])
        elif letter:
            words.append(bytes([c]))
        elif words and words[-1] is not None:
            words.append(None)
    vectors, counts = [], np.zeros(len(model.lang_names))
    for w in filter(None, words):
        buckets = toxicity.word_buckets(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]
        vectors.append(sum(model.embed[b].astype(float) for b in buckets))
        counts += model.lang_log[buckets[0]]
    best = []
    for width, conv in zip(toxicity.WIDTHS, model.conv, strict=True):
        for f in range(toxicity.FILTERS):
            best.append(max((sum(float(vectors[i + j] @ conv[j][:, f]) for j in range(width) if i + j < len(vectors)) for i in range(len(vectors))), default=-math.inf))
    z = float(model.out_bias) + sum(max(b + float(c), 0) * float(o) for b, c, o in zip(best, model.bias, model.out, strict=True))
    return 1 / (1 + math.exp(-(z - float(model.lang_shift[counts.argmax()]))))


def test_toxicity(spark):
    rng = random.Random(11)
    data, marks = [], []
    for i in range(900):
        text, toxic = words(rng, rng.randint(5, 80)), i % 3 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), "vek" + rng.choice(["ta,", "tomo", "TAlu."]))
        data.append((i, " ".join(text), "en" if i % 2 else "fr", "s", 1))
        marks.append((i, int(toxic)))
    data += [(2000, None, "en", "s", 1), (2001, "", None, "s", 1), (2002, "vekta " * 50000, None, None, 1), (None, "12", "en", "s", 1)]
    docs, labels = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([*marks, marks[0], (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, remainder(5) != 0, fit_rows=500)
    got = {r.doc_id: r for r in toxicity.rate(docs, model).collect()}
    assert len(got) == len(data)
    out = [(bool(got[i].predicted), bool(t)) for i, t in marks if held(i, 5, 0)]
    assert sum(p == t for p, t in out) >= 0.95 * len(out)
    assert got[2002].predicted == 1 and got[2000].predicted == 0 and got[2001].score == got[2000].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    for i, text, *_ in [*data[:40], data[900], data[901]]:
        assert got[i].score == pytest.approx(plain_toxicity(model, text), abs=1e-4)
    odd = docs.withColumns({c: F.lit("clash") for c in ("score", "predicted", "toxic", "words")})
    assert {r.doc_id: r.score for r in toxicity.rate(odd, toxicity.fit(odd, labels, remainder(5) != 0, fit_rows=500)).collect()} == {i: r.score for i, r in got.items()}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.rate(empty(spark), None).collect() == []


def test_toxicity_thresholds_weigh_the_labels():
    z, y = np.arange(20.0), np.array([0] * 8 + [1, 0, 1, 0] + [1] * 8)
    assert toxicity.best_threshold(z, y, 0.0, (1, 1)) in (7.5, 8.5, 9.5, 10.5, 11.5)
    assert toxicity.best_threshold(z, y, 0.0, (100, 1)) == 11.5
    assert toxicity.best_threshold(z, y, 0.0, (1, 100)) == 7.5


# Bloom-filter language model


def test_bloom_counts_are_kept():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**48, 20000, dtype=np.uint64))
    counts = np.append(rng.geometric(0.3, len(keys) - 6), [46, 47, 100, 1000, 10**6, 10**12])
    one = np.zeros(len(keys), np.int64)
    made = bloom_lm.Filter.built(keys, bloom_lm.class_of(counts), 20)
    got = made.read(one, keys)
    assert (got >= bloom_lm.class_of(counts)).all() and (got == bloom_lm.class_of(counts)).mean() > 0.99
    assert np.abs(bloom_lm.quantised(got) / counts - 1)[got == bloom_lm.class_of(counts)].max() < 0.012
    assert (made.read(one[:1].repeat(200_000), rng.integers(0, 2**48, 200_000, dtype=np.uint64)) > 0).sum() <= 3
    fill = np.unpackbits(made.bits).mean()
    assert 0.45 < fill < 0.52


def test_bloom_groups_lie_end_to_end():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 2**48, n, dtype=np.uint64)) for n in (10, 3000, 500)]
    made = [bloom_lm.Filter.built(p, np.full(len(p), 1 + i), 20) for i, p in enumerate(parts)]
    whole = bloom_lm.Filter(np.concatenate([m.bits for m in made]), np.concatenate([m.sizes for m in made]).astype(np.int64), 20)
    for i, p in enumerate(parts):
        assert (whole.read(np.full(len(p), i), p) == made[i].read(np.zeros(len(p), np.int64), p)).all()
        assert (whole.read(np.full(len(p), (i + 1) % 3), p) == 0).all()


def test_bloom_head_finds_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        head = bloom_lm.Head(keys[::-1], np.arange(len(keys))[::-1])
        assert (head.find(keys) == np.arange(len(keys))).all()
        assert (head.find(rng.integers(0, 2**64, 1000, dtype=np.uint64)) == -1).all()


class PlainLM:
    """The same model from exact counts in dictionaries, class by class."""

    def __init__(self, texts, prior):
        self.uni, self.bi, self.k = Counter(), Counter(), prior
        for t in texts:
            ws = self.tokens(t)
            self.uni.update(ws)
            self.bi.update(zip(["\0end", *ws[:-1]], ws, strict=True))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.c = sum(map(self.read, self.uni.values()))
        self.false = self.v / 2 ** (2 * math.ceil(max(math.log2(self.v), 8) / 2))

    @staticmethod
    def tokens(text):
        return [*WORD.findall(lowered(text)), "\0end"]

    @staticmethod
    def read(count):
        if count <= 46:
            return count
        return 46 * math.exp((math.ceil(46 * math.log(count / 46)) - 0.5) / 46)

    def word(self, w):
        return (self.read(self.uni[w]) + 0.5) / (self.c + 0.5 * (self.v + 1))

    def given(self, h, w):
        return (self.read(self.bi[h, w]) + self.k * self.word(w)) / (self.read(self.uni[h]) + self.k + self.false)

    def score(self, text):
        ws = self.tokens(text)
        return sum(math.log10(self.given(h, w)) for h, w in zip(["\0end", *ws[:-1]], ws, strict=True))


@pytest.mark.parametrize("max_bytes", [bloom_lm.MAX_BYTES, 0])
@pytest.mark.parametrize("prior", [1.0, bloom_lm.PRIOR])
def test_bloom_scores_are_the_models(spark, max_bytes, prior):
    data = [*rows(), *[(6000 + i, "the cat and the dog and the cow " * 40, "en", "a", 1) for i in range(3)]]
    got = bloom_lm.score(spark.createDataFrame(data, SCHEMA), remainder(5) == 1, max_bytes, prior).collect()
    plain = PlainLM([r[1] for r in data if not held(r[0], 5, 1)], prior)
    by_id = {r.doc_id: r for r in got}
    off = np.array([by_id[r[0]].score - plain.score(r[1]) for r in data])
    size = np.array([by_id[r[0]].n_tokens for r in data])
    # an entry in 256 is read one class too high, which is 0.3 at most
    assert (np.abs(off) < 0.7 + 0.002 * size).all() and np.abs(off).sum() < 0.002 * size.sum() and np.median(np.abs(off)) < 1e-6


def test_bloom_probabilities_sum_to_one(spark):
    """The filter itself, as it is built from the documents: sums over all words it has learned and one unknown."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(remainder(5) != 1)
    counted = bloom_lm.counted_groups(train, 4).collect()
    v = sum(r.distinct for r in counted)
    probes = 2 * math.ceil(math.log2(v) / 2)
    scorer = bloom_lm.Scorer(sum(r.n for r in counted), v, sum(r.mass for r in counted) / bloom_lm.MASS, bloom_lm.PRIOR, probes)
    made = {r.group: bloom_lm._group_filter(r.asDict(), probes) for r in counted}
    whole = bloom_lm.Filter(np.concatenate([made[g][0].bits for g in range(4)]), np.array([8 * len(made[g][0].bits) for g in range(4)]), probes)
    words = np.concatenate([made[g][1] for g in range(4)])
    level = whole.read(bloom_lm.group_of(words, 4), bloom_lm.word_low(words))
    weight, sums = scorer.weight(level), []
    often = np.argsort(-level)[:40]
    for i in [*often, *np.random.default_rng(4).integers(0, len(words), 60)]:
        keys = bloom_lm.bigram_key(np.full(len(words), words[i]), words)
        pair = whole.read(bloom_lm.group_of(keys, 4), keys & np.uint64(2**48 - 1))
        share = bloom_lm.quantised(level[i]) + scorer.prior + scorer.false
        sums.append((bloom_lm.quantised(pair).sum() + weight.sum() + scorer.weight(0)) / share)
    assert 0.98 < min(sums) and max(sums) < 1.02


def test_bloom_scores(spark):
    data = rows()
    got = bloom_lm.score(spark.createDataFrame(data, SCHEMA), remainder(5) == 1).collect()
    assert len(got) == len(data)
    toks = [(r[0], [*WORD.findall(lowered(r[1])), "\0end"]) for r in data]
    c = Counter(w for i, ws in toks if not held(i, 5, 1) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i, 5, 1), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in toks)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


@pytest.mark.parametrize("least", [1, 300, 1 << 20])
def test_bloom_groups_score_like_the_broadcast(spark, monkeypatch, least):
    monkeypatch.setattr(bloom_lm, "HEAD_WORDS", least)
    monkeypatch.setattr(bloom_lm, "HEAD_PAIRS", least)
    monkeypatch.setattr(bloom_lm, "ASK_DOCS", 16)

    def scores(max_bytes):
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in bloom_lm.score(documents(spark), remainder(5) == 1, max_bytes).collect())

    whole, dealt = scores(bloom_lm.MAX_BYTES), scores(0)
    assert [x[:4] for x in whole] == [x[:4] for x in dealt]
    assert [x[4] for x in dealt] == pytest.approx([x[4] for x in whole], rel=1e-5)


def test_bloom_keys_in_order_come_back():
    for n in (0, 5, 5000, 200_000):
        keys = np.sort(np.random.default_rng(n).integers(0, 2**48, n, dtype=np.uint64))
        assert (bloom_lm._from_order(bloom_lm._in_order(keys)) == keys).all()


def test_bloom_other_columns(spark):
    odd = documents(spark).withColumns({c: F.lit("clash") for c in ("row", "score", "held_out", "chunk", "group")})
    want = sorted((r.doc_id or -1, round(r.score, 6)) for r in bloom_lm.score(documents(spark), remainder(5) == 1).collect())
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in bloom_lm.score(odd, remainder(5) == 1).collect()) == want


def test_bloom_without_training_rows(spark):
    assert bloom_lm.score(empty(spark), remainder(5) == 1).collect() == []
    only = bloom_lm.score(documents(spark), F.lit(True)).collect()
    assert len(only) == len(rows()) and all(r.train_tokens == 0 and r.n_known == 0 for r in only)


# lattice links


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 2
    got = lattice_dedup.decode_e8(x) / 2
    assert (((2 * got) % 2 == 0).all(axis=1) | ((2 * got) % 2 == 1).all(axis=1)).all() and (got.sum(axis=1) % 2 == 0).all()
    for r in lattice_dedup._roots():  # no neighbour is nearer
        assert (((x - got) ** 2).sum(axis=1) <= ((x - got - r) ** 2).sum(axis=1) + 1e-9).all()


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.mark.parametrize("block", [2048, 16])
def test_lattice(spark, block):
    rng = np.random.default_rng(5)
    data, centre = [], rng.normal(size=(20, 32))
    for i in range(600):
        noise = rng.normal(size=32) * rng.choice([0.0, 0.05, 0.1, 0.4])
        data.append((i, [float(v) for v in (centre[i % 20] * rng.choice([1, 2]) + noise).astype(np.float32)], int(i % 20) % 3))
    odd = [(700, None, 1), (701, [], 1), (702, [0.0] * 32, 1), (703, [float("nan")] * 32, 1), (704, [None] * 32, 1), (705, data[0][1], None), (706, data[0][1][:8], 0), (707, data[3][1], data[3][2]), (707, data[3][1], data[3][2])]
    got = lattice_dedup.link(spark.createDataFrame(data + odd, VECTORS), block=block).collect()
    assert len(got) == len(data) + len(odd)
    x = np.array([v for _, v, _ in data] + [data[3][1]] * 2, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for *_, k in data] + [data[3][2]] * 2)
    same = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(same, False)
    found = {r.vec_id: r.n_links for r in got}
    true = dict(zip([*range(600), 707], same.sum(axis=1).tolist(), strict=False))
    assert all(found[i] <= true[i] for i in true)
    assert sum(found[i] for i in true) >= 0.95 * sum(true.values())
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if 700 <= r.vec_id <= 706)
    assert all(r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id for r in got)


def test_lattice_other_columns(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(v) for v in rng.normal(size=8)], 1) for i in range(30)] * 2
    docs = spark.createDataFrame(data, VECTORS)
    odd = docs.withColumns({c: F.lit("clash") for c in ("class", "copies", "n_links", "mark", "cells")})
    want = sorted(map(tuple, lattice_dedup.link(docs).collect()))
    assert sorted(map(tuple, lattice_dedup.link(odd).collect())) == want and {r[1] for r in want} == {1}


def test_lattice_empty(spark):
    assert lattice_dedup.link(spark.createDataFrame([], VECTORS)).collect() == []
