"""Line dedup, n-gram Jaccard join, suffix dedup and components against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, ngram_join, suffix_dedup
from larkspur.llm.components import connected_components

from .helpers import SCHEMA, WORD, changed, documents, empty, lowered, prose, rows


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def kept_lines(docs, percent, least):
    """Text and number of removed lines of each distinct (id, text), by comparing all pairs."""
    lines = [((order(d), pos), set(WORD.findall(line)), (d, t, pos)) for d, t in docs if t is not None for pos, line in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if len(x[1]) >= least), key=lambda x: x[0])
    gone = set()
    for i, (_, words, at) in enumerate(lines):
        if any(100 * len(words & w) >= percent * len(words | w) for _, w, _ in lines[:i]):
            gone.add(at)
    return {(d, t): ("\n".join(x for p, x in enumerate(t.split("\n")) if (d, t, p) not in gone), sum((d, t, p) in gone for p in range(t.count("\n") + 1))) for d, t in docs if t is not None}


@pytest.mark.parametrize("percent", [90, 80])
def test_lines(spark, percent):
    rng = random.Random(2)
    base = rows()
    line = " ".join(["common", *prose(rng, 1, 20).split(" ")])
    base += [(1000 + i, f"{prose(rng, 1, 9)}\n{changed(rng, line, i % 3)}", "en", "a", 1) for i in range(40)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(base, SCHEMA), percent).collect()
    assert len(got) == len(base)
    want = kept_lines({(r[0], r[1]) for r in base}, percent, line_dedup.MIN_TOKENS)
    before = {}
    for r in base:
        before.setdefault((r[0], r[4], r[3]), []).append(r[1])
    assert sorted(str((r.text, r.n_removed)) for r in got if r.text is not None) == sorted(str(want[r[0], r[1]]) for r in base if r[1] is not None)
    assert sum(r.text is None and r.n_lines == 0 for r in got) == sum(r[1] is None for r in base)


def test_lines_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, line_dedup.drop_repeated_lines(documents(spark)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_dedup.drop_repeated_lines(documents(spark)).collect())) == want


def test_lines_alike_however_many_classes_are_hot(spark):
    copies = [(100 + i, "one very common line of words\na line of document %d alone here" % i, "en", "s", 1) for i in range(60)]
    docs = documents(spark).union(spark.createDataFrame(copies, SCHEMA))
    found = [sorted((r.d, r.v, sorted(r.places)) for r in line_dedup.repeated_lines(docs, hot_classes=n).collect()) for n in (0, 3, line_dedup.HOT_CLASSES)]
    assert found[0] == found[1] == found[2]
    assert sum(0 in places for d, _, places in found[0] if 100 <= d < 160) == 59


def test_lines_keep_other_columns_and_nothing(spark):
    names = ("n_lines", "places", "d", "_d", "_v", "_places", "_lines", "_row", "a.b")
    odd = documents(spark).withColumns({c: F.lit("clash") for c in names})
    got = line_dedup.drop_repeated_lines(odd)
    assert {"doc_id", "text", *names, "n_removed"} == set(got.columns) - {"lang", "source", "n_chars"}
    assert {r["_places"] for r in got.collect()} == {"clash"}
    assert got.count() == odd.count()


def test_lines_alike_when_every_line_is_named_often(spark, monkeypatch):
    rng = random.Random(12)
    line = prose(rng, 1, 12)
    more = [(100 + i, f"{changed(rng, line, i % 3)}\n{prose(rng, 1, 9)}", "en", "s", 1) for i in range(60)]
    docs = documents(spark).union(spark.createDataFrame(more, SCHEMA))
    want = sorted((r.d, r.v, sorted(r.places)) for r in line_dedup.repeated_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "HOT_CLASSES", 1 << 20)
    assert sorted((r.d, r.v, sorted(r.places)) for r in line_dedup.repeated_lines(docs).collect()) == want


def test_lines_verify_with_two_scans_of_the_texts(spark, tmp_path):
    """One for each side of the pairs; none to find which lines are named often."""
    documents(spark).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    pairs = spark.createDataFrame([(1, 2, 3, 4)], "d long, ord long, e_d long, e_ord long")
    plan = line_dedup._similar(pairs, docs, 90)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_lines_nothing(spark):
    assert line_dedup.drop_repeated_lines(empty(spark)).collect() == []


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(docs, n, percent):
    s = {i: shingles(t, n) for i, t in docs.items()}
    sets, ids = Sets(), sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                sets.join(a, b)
    return {i: (len(s[i]), sets.find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_jaccard_components(spark, n, percent):
    rng = random.Random(4)
    base = rows(3)
    seed = prose(rng, 4, 20)
    base += [(2000 + i, changed(rng, seed, 1 + i % 4), "en", "a", 1) for i in range(60)]
    base = [r for r in base if r[0] is not None]
    got = ngram_join.link_components(spark.createDataFrame(base, SCHEMA), n, percent).collect()
    want = jaccard_components({r[0]: r[1] for r in base}, n, percent)
    assert len(got) == len(base)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *w) for i, w in want.items()}


def test_jaccard_without_ids_and_rows(spark):
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(documents(spark)).collect()}
    assert got[None] is None
    assert ngram_join.link_components(empty(spark)).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(none).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_jaccard_ranks_count_sets(spark):
    texts = ["a b c d", "a b c e", "x a b c", "q r s"] * 3 + [None, ""]
    ranks = ngram_join.bucket_ranks(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 3)
    assert len(ranks) == 1 << 18
    assert sorted(ranks[ranks > 0].tolist()) == [int(2 * math.log2(x)) for x in (3, 3, 3, 3, 9)]


def test_jaccard_other_columns(spark):
    odd = documents(spark).withColumns({c: F.lit("clash") for c in ("set_id", "component_id", "n", "key", "prefix")})
    want = sorted(str((r.doc_id, r.component_id)) for r in ngram_join.link_components(documents(spark)).collect())
    assert sorted(str((r.doc_id, r.component_id)) for r in ngram_join.link_components(odd).collect()) == want


def test_jaccard_blocks_of_a_hot_key(spark, monkeypatch):
    rng = random.Random(8)
    seed = prose(rng, 3, 20)
    base = {i: changed(rng, seed, 2 + i % 3) for i in range(80)}
    df = spark.createDataFrame(list(base.items()), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "_RUN", 8)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    want = jaccard_components(base, 3, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df, 3, 80).collect()} == {(i, *w) for i, w in want.items()}


def covered(docs, length):
    seen, out = set(), {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[i] = (len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows():
    rng = random.Random(5)
    base = {r[0]: r[1] for r in rows() if r[0] is not None}
    passage = prose(rng, 2, 15)
    for i in range(40):
        base[3000 + i] = f"{prose(rng, 1, 8)} {passage}{prose(rng, 1, 6)}"
    base |= {4000: "ab" * 500, 4001: "ab" * 80 + "c", 4002: "x" * 99, 4003: "x" * 230, 4004: "é" * 130, 4005: passage * 3}
    return base


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix(spark, hot):
    base = suffix_rows()
    df = spark.createDataFrame(list(base.items()), "doc_id long, text string")
    got = suffix_dedup.strip_repeats(df, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got} == covered(base, 100)


def test_suffix_small_chunks_and_shuffles(spark, monkeypatch):
    base = suffix_rows()
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 2000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    got = suffix_dedup.strip_repeats(spark.createDataFrame(list(base.items()), "doc_id long, text string")).select("doc_id", "n_removed", F.sha2("kept", 256).alias("h")).collect()
    want = covered(base, 100)
    assert {r.doc_id: (r.n_removed, r.h) for r in got} == {i: (w[1], w[3]) for i, w in want.items()}


def test_suffix_repeated_rows_and_nothing(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (1, text, 2)], "doc_id long, text string, kept int")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.strip_repeats(df).collect()) == [(0, 0), (1, 400), (1, 400)]
    assert suffix_dedup.strip_repeats(empty(spark)).collect() == []


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_suffix_counts_a_repeated_row_once(spark, hot):
    rng = random.Random(8)
    alone, passage = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    base = {1: alone, 2: "ab" * 300, **{i: f"{prose(rng, 1, 8)} {passage}{prose(rng, 1, 6)}" for i in range(3, 12)}}
    df = spark.createDataFrame([*base.items(), *base.items(), (1, alone)], "doc_id long, text string")
    got = suffix_dedup.strip_repeats(df, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    want = covered(base, 100)
    assert want[1][1] == 0 and len(got) == 2 * len(base) + 1
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got} == {(i, *w) for i, w in want.items()}


def test_suffix_settles_a_common_passage_without_its_copies(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    passage, seen, settle = prose(rng, 2, 12), str(tmp_path / "rows"), suffix_dedup._settle
    base = {i: f"{prose(rng, 1, 8)} {passage}{prose(rng, 1, 6)}" for i in range(200)} | {i: prose(rng, 1, 8) + "-" * (300 + i) for i in range(200, 260)}

    def spy(length):
        def counted(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.writelines(f"{key}\n" for key in batch["key"].to_pylist())
                yield batch

        return lambda batches: settle(length)(counted(batches))

    monkeypatch.setattr(suffix_dedup, "_settle", spy)
    df = spark.createDataFrame(list(base.items()), "doc_id long, text string")
    got = suffix_dedup.strip_repeats(df, hot=20).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got} == covered(base, 100)
    with open(seen) as f:
        assert max(Counter(f).values()) <= 20  # not one for each document with the passage


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            assert got[a] == sets.find(a) and got[b] == sets.find(b)


def test_components_of_hubs(spark):
    """Nodes with more links than one task is given: the least of all, the greatest, one between, and a chain through them."""
    edges = [(0, n) for n in range(1000, 1400)] + [(9000, n) for n in range(2000, 2400)] + [(2700, n) for n in range(2401, 3000)]
    edges += [(n, n + 1) for n in range(4000, 4030)] + [(4000, 9000)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: sets.find(n) for e in edges for n in e}
