"""Mixing sources to target weights with Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) take the weights 5, 2, 1, repeating.
Their targets share all words by weight, each held to three times its source's
words, the excess shared again by weight. Blocks of ``block`` words go to
sources by highest quotients ``target / (2k + 1)``, and each source's blocks to
its shards in the same way by shard size, so every shard has an integer quota.
Inside a shard the documents form a ring in seeded order: a quota of q blocks
takes q * block consecutive words of the ring, whole turns first. Shards hold
about ``shard_docs`` documents, so a hot source becomes many shards and no
window holds a whole source.

The highest-quotient rule is applied in closed form, a divisor for most seats
and a ranking for the last few. Only the table of sources passes through a
single window.

Defined results: null or blank texts have size 0 and take 0; a null source is a
source of its own; repeated rows each count; an empty table gives no rows;
further columns are kept unless an output column has their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._common import cut

BLOCK = 16
SHARD_DOCS = 4096
CYCLE = (5, 2, 1)
MAX_REPEAT = 3
#: Sources that may be broadcast, after they are counted.
BROADCAST_SOURCES = 1 << 16


def _seats(df: DataFrame, group: list[str], share: str, blocks: str, ident: str) -> DataFrame:
    """Sainte-Lague seats of each row of a group for ``blocks`` in all, in proportion to ``share``.

    The divisor total / (blocks - n/2) seats at most ``blocks`` and more than
    ``blocks - n`` of them among n rows, all of which are among the highest
    quotients. The rest is ranked: until all are seated a row gains at most
    n * share / total + 1 seats, so about 3n quotients decide.
    """
    g = [F.col(c) for c in group] or [F.lit(0)]
    w = Window.partitionBy(*g)
    part, n = F.col(share) / F.sum(share).over(w), F.count(F.lit(1)).over(w)
    df = df.withColumn("_low", F.when(F.col(share) > 0, F.floor(part * F.greatest(F.col(blocks) - n / 2, F.lit(0.0)) + 0.5)).otherwise(0).cast("long"))
    df = df.withColumn("_most", F.when(F.col(share) > 0, F.ceil(part * n) + 1).otherwise(0).cast("int"))
    df = df.withColumn("_left", F.greatest(F.col(blocks) - F.sum("_low").over(w), F.lit(0)))
    quotients = df.where("_most > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("_k"))
    best = w.orderBy(F.desc(F.col(share) / (2 * (F.col("_low") + F.col("_k")) + 1)), ident, "_k")
    more = quotients.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left")
    more = more.groupBy(*[F.col(c).alias(f"_m{i}") for i, c in enumerate([*group, ident])]).agg(F.count(F.lit(1)).alias("_more"))
    same = F.lit(True)
    for i, c in enumerate([*group, ident]):
        same &= F.col(c).eqNullSafe(F.col(f"_m{i}"))
    out = df.join(more, same, "left")
    return out.select(*[c for c in df.columns if c[:4] not in ("_low", "_mos", "_lef")], (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("seats"))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, docs, target: shares by weight held to ``max_repeat`` times the source's size.

    Water filling over the sources in order of cap / weight: those whose cap is
    below the level that the rest would share are held, the others share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * float(max_repeat))
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_held", F.col("_cap") / F.col("weight") <= F.col("_level"))
    free = F.max(F.when(~F.col("_held"), F.col("_level"))).over(everything)
    return per.select("source", "source_size", "docs", "weight", F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("weight") * free).alias("target"))


def mix(documents: DataFrame, size: str = "size", seed: str = "mix", block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """All columns of ``documents`` plus size, source_size, target, taken, whole_turns and part_words.

    ``taken = whole_turns * size + part_words``; the part is the text's first
    ``part_words`` words. In each shard one text at most is taken in part.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    made = {"size", "source_size", "target", "taken", "whole_turns", "part_words"}
    kept = [c for c in documents.columns if c not in made]
    # the rows travel whole in one column, so none of their names can clash
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", "source", F.col(f"`{size}`").alias(size), order.alias("_order"))
    targets = source_targets(docs.select("source", F.col(size).alias("size")))
    targets = targets.withColumn("_shards", F.ceil(F.col("docs") / F.lit(shard_docs)).cast("long"))
    # sources under a key that is never null, so that joins and windows share one partitioning and rows move once
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    targets, docs = targets.withColumn("_key", key), docs.withColumn("_key", key)
    targets = cut(targets)
    told = targets.select("_key", "source_size", "target", "_shards")
    # a join on the source alone would put a hot source into one task
    if targets.count() <= BROADCAST_SOURCES:
        placed = docs.join(F.broadcast(told), "_key")
    else:
        salt = F.conv(F.substring("_order", 9, 2), 16, 10).cast("int")  # 0 to 255
        every = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(255))))
        placed = docs.withColumn("_salt", salt).join(every, ["_key", "_salt"]).drop("_salt")
    placed = placed.withColumn("_shard", F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.col("_shards")))
    shards = placed.groupBy("_key", "_shard").agg(F.sum(size).alias("_words"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    seats = _seats(targets.select("_key", "source_size", "target", F.floor(total / block).alias("_blocks")), [], "target", "_blocks", "_key")
    # a quota never passes max_repeat turns of its source
    seats = seats.select("_key", F.least(F.col("seats"), F.floor(F.col("source_size") * MAX_REPEAT / block)).cast("long").alias("_quota"))
    quotas = _seats(shards.join(seats, "_key"), ["_key"], "_words", "_quota", "_shard")
    quotas = quotas.select("_key", "_shard", "_words", F.least(F.col("seats") * block, F.col("_words") * MAX_REPEAT).alias("_take"))
    ring = Window.partitionBy("_key", "_shard").orderBy("_order", "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    ringed = placed.withColumn("_at", F.coalesce(F.sum(size).over(ring), F.lit(0)))
    ringed = ringed.join(quotas, ["_key", "_shard"])
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long")
    rest = F.col("_take") - whole * F.col("_words")
    part = F.greatest(F.least(F.col("_at") + F.col(size), rest) - F.col("_at"), F.lit(0))
    return ringed.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col(size).cast("long").alias("size"),
        F.col("source_size").cast("long"),
        F.col("target"),
        (whole * F.col(size) + part).cast("long").alias("taken"),
        whole.alias("whole_turns"),
        part.cast("long").alias("part_words"),
    )
