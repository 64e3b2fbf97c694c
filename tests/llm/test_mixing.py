from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing
from larkspur.llm.queries import word_count

from .helpers import WORD, documents, empty, rows


def targets(sizes, cycle=(5, 2, 1), most=3):
    """Share by weight; hold those above their limit, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(most * sizes[s]) for s in over}


def sainte_lague(shares, seats):
    got = dict.fromkeys(shares, 0)
    for _ in range(seats):
        got[max(shares, key=lambda s: (shares[s] / (2 * got[s] + 1), s))] += 1
    return got


def test_targets_and_taken(spark):
    got = mixing.mix(documents(spark).withColumn("size", word_count())).collect()
    size = defaultdict(int)
    for _, text, _, source, _ in rows():
        size[source] += len(WORD.findall(text or ""))
    want, taken = targets(size), defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK


def test_small_source_is_held_at_three_times(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10000), (3, "c", 5000)], "doc_id long, source string, size long")
    got = {r["source"]: r for r in mixing.mix(df, block=1).collect()}
    assert got["a"]["target"] == 30 and got["a"]["taken"] == 30
    assert got["b"]["taken"] <= 30000


def test_seats_are_sainte_lague(spark):
    shares = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 1.0, "e": 0.0}
    for blocks in (1, 2, 7, 100, 1001):
        df = spark.createDataFrame([(k, v, blocks) for k, v in shares.items()], "k string, v double, n long")
        got = {r["k"]: r["seats"] for r in mixing._seats(df, [], "v", "n", "k").collect()}
        want = sainte_lague({k: v for k, v in shares.items() if v}, blocks)
        assert sum(got.values()) == blocks
        assert got == {k: want.get(k, 0) for k in shares}, (blocks, got, want)


@pytest.mark.parametrize("few", [mixing.BROADCAST_SOURCES, 0])
def test_many_shards_and_reruns_agree(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), (F.col("id") % 50).alias("size"), F.lit("x").alias("target"))
    one, two = (sorted(mixing.mix(df, shard_docs=64).select("doc_id", "taken").collect()) for _ in range(2))
    assert one == two
    per = mixing.mix(df, shard_docs=64).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"))
    for r in per.collect():
        assert abs(r["t"] - r["w"]) < 0.05 * r["w"] + 2 * mixing.BLOCK


def test_empty_and_blank(spark):
    assert mixing.mix(empty(spark).withColumn("size", word_count())).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, source string").withColumn("size", F.lit(0).cast("long"))
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]
