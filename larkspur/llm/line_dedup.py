"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is a stretch between newlines; its tokens are its distinct words
(``[^\\x20\\x09-\\x0D]+``). A line is removed when an earlier line, by document
id and place, has the same tokens or a Jaccard similarity of at least
``percent`` / 100 with it, whether or not that line stays itself. Lines with
fewer than ``min_tokens`` tokens always stay.

Tokens are ordered by rarity: a table of hash buckets counts the words of all texts,
and a token's rank is its bucket's count. The table grows with the texts, from 2^12
to 2^19 buckets, so that rare words stay told from frequent ones. Lines with equal
tokens form a class. The prefix filter joins classes on the first ``n - ceil(t *
n) + 1`` tokens, of which the smaller set needs fewer; length and positional filters and the parities of 64 hash
ranges bound the overlap before sets are compared. Sets so small that one token more
is too much (below 9 tokens at 90 percent) are like their equals only and take no part. Each class is first compared
with the earliest class under each key; only classes that this leaves in place
are then compared with all earlier ones, so a large group of near copies does not
make all its pairs. A class that holds a large share of all repeated lines is
told to them by broadcast, and a line that a large share of all candidates name is
met in ``SALTS`` parts, so that no task follows the most common line. (The two
windows over a token's postings do pass through one task each, sorted and without
words.)

Defined results: null texts have no lines and stay null; an empty text is one
empty line; rows that repeat a document, id and text alike, are treated as that
document and come out alike; rows with one id and different texts are different
documents, ordered by a hash of the text; null ids come first; texts of any length
are split whole; all other columns are kept, whatever their names, but for n_lines
and n_removed, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._common import cut, stored

PERCENT = 90
MIN_TOKENS = 5
#: Binary logarithms of the least and the largest table of ranks, and the bytes of text behind a bucket in between.
RANK_BITS = (12, 19)
BYTES_PER_BUCKET = 1 << 14
#: Rows that may be broadcast, after they are counted; each holds an id and a few places. More are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
BROADCAST_PLACES = 1 << 20
#: Classes with more than one part in so many of all repeated lines are broadcast; there are fewer than this.
HOT_CLASSES = 1 << 12
SALTS = 32
_NO_ID = -(2**63)


def _blanked(text: Column) -> Column:
    for c in ("\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _hashes(line: Column) -> Column:
    """Distinct hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _ranks(documents: DataFrame) -> tuple[Column, int]:
    """How common the words of each hash bucket are, as a constant array of numbers below 128 in the highest byte, and a mask that gives the bucket of a hash."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mask = (1 << min(max((size // BYTES_PER_BUCKET).bit_length(), RANK_BITS[0]), RANK_BITS[1])) - 1
    # rarer blanks are not told apart here: the order of tokens need only be the same everywhere
    words = documents.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    got = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(mask)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most 2^19 rows
    ranks = np.zeros(mask + 1, np.int64)
    ranks[got["bucket"].to_numpy()] = np.minimum(127, np.rint(4 * np.log2(got["n"].to_numpy())))
    return F.split(F.lit(",".join(map(str, (ranks << 56).tolist()))), ",").cast("array<bigint>"), mask  # folded to a constant


def _keys(line: Column, ranks: Column, mask: int) -> Column:
    """Sorted distinct token keys of a line, rare first: rank, then hash.

    One pass over the words, whose function is interpreted; what it gives holds no
    nulls, so that the words are made distinct and sorted by compiled code on numbers.
    """

    def key(word: Column) -> Column:
        h = F.xxhash64(word)
        return F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(mask))), F.lit(0).cast("long")).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.array_except(F.transform(F.split(line, " "), key), F.array(key(F.lit("")))))


def _lines(documents: DataFrame) -> DataFrame:
    """d, ord and line of every line; ord holds 31 bits of the text's hash, then the place."""
    docs = documents.where("text is not null").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), _version(F.col("text")).alias("v"), _blanked(F.col("text")).alias("t"))
    placed = docs.select("d", "v", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    return placed.select("d", F.shiftleft(F.col("v"), 32).bitwiseOR(F.col("pos").cast("long")).alias("ord"), "line")


def _version(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _index_length(n: Column, percent: int) -> Column:
    """How far into the smaller of two similar sets their first shared token can lie."""
    return n - F.ceil(2 * percent * n / (100 + percent)).cast("int") + 1


def _close(x: str, y: str, percent: int) -> Column:
    """Length, positional and parity filters on two postings of one key."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    room = F.least(a - F.col(f"{x}.i"), b - F.col(f"{y}.i")) + F.least(F.col(f"{x}.i"), F.col(f"{y}.i"))
    apart = F.bit_count(F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity")))
    low = F.when(a <= b, F.col(f"{x}.i")).otherwise(F.col(f"{y}.i"))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (low < _index_length(F.least(a, b), percent)) & (room >= _need(a, b, percent)) & (apart <= a + b - 2 * _need(a, b, percent))


def _small(df: DataFrame, places: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted size is under the bounds."""
    n, p = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(places) if places is not None else F.count(F.lit(1)), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and p <= BROADCAST_PLACES else df


def _named_often(pairs: DataFrame, line: tuple[str, str], total: int) -> DataFrame:
    """The fewer than HOT_CLASSES lines that a large share of all pairs name."""
    often = pairs.groupBy(*line).agg(F.count(F.lit(1)).alias("named")).where(F.col("named") * HOT_CLASSES > total)
    return F.broadcast(often.select(*line, F.lit(True).alias("often")))


def _with_words(pairs: DataFrame, sets: DataFrame, often: DataFrame, line: tuple[str, str], other: tuple[str, str], name: str) -> DataFrame:
    """Pairs with the words of one of their lines. A line that is named often is met in parts, dealt by the other line."""
    salt = F.when(F.col("often"), F.pmod(F.xxhash64(*other), F.lit(SALTS))).otherwise(0).cast("int")
    told = sets.select(F.col("d").alias(line[0]), F.col("ord").alias(line[1]), F.col("words").alias(name)).join(often, [*line], "left")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("often"), SALTS - 1).otherwise(0)))).drop("often")
    salted = pairs.join(often, [*line], "left").withColumn("salt", salt).drop("often")
    return salted.join(told, [*line, "salt"]).drop("salt")


def _similar(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """d and ord of the later line of each pair (d, ord, e_d, e_ord) that reaches the similarity."""
    pairs = cut(pairs.distinct())
    ends = pairs.select(F.explode(F.array(F.struct("d", "ord"), F.struct(F.col("e_d").alias("d"), F.col("e_ord").alias("ord")))).alias("x")).select("x.d", "x.ord")
    wanted = ends.groupBy("d", F.shiftright("ord", 32).alias("v")).agg(F.collect_set(F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("places"))
    wanted = _small(cut(wanted.withColumnRenamed("d", "w_d").withColumnRenamed("v", "w_v")), F.size("places"))
    docs = documents.where("text is not null").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "text")
    met = docs.join(wanted, F.col("d") == F.col("w_d")).where(_version(F.col("text")) == F.col("w_v"))
    lines = met.select("d", F.col("w_v").alias("v"), "places", F.explode(F.array(F.split(_blanked(F.col("text")), "\n"))).alias("lines")).select("d", "v", F.explode(F.transform("places", lambda p: F.struct(p.alias("pos"), F.get("lines", p).alias("line")))).alias("x"))
    sets = lines.select("d", F.shiftleft("v", 32).bitwiseOR(F.col("x.pos").cast("long")).alias("ord"), _hashes(F.col("x.line")).alias("words"))
    sets = sets.dropDuplicates(["d", "ord"])
    total = pairs.count()
    # both lists come from the pairs as they are: from the joined ones, the texts would be read again for the list alone
    line, other = ("d", "ord"), ("e_d", "e_ord")
    both = _with_words(pairs, sets, _named_often(pairs, line, total), line, other, "words")
    both = _with_words(both, sets, _named_often(pairs, other, total), other, line, "e_words")
    shared = F.size(F.array_intersect("words", "e_words"))
    return both.where(100 * shared >= percent * (F.size("words") + F.size("e_words") - shared)).select("d", "ord").distinct()


def _later_lines(lines: DataFrame, same: list[str], hot_classes: int) -> tuple[DataFrame, Callable[[], None]]:
    """d and ord of all but the first line of each class, and the removal of the table of classes they are read from.

    The lines of a class with a large share of all repeated lines would meet in one
    task of a join on the class, so the few such classes are broadcast instead.
    """
    many, drop_many = stored(lines.groupBy(*same).agg(F.min(F.struct("d", "ord")).alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1"))
    total = many.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    is_hot = F.col("lines") * hot_classes > total
    hot, rest = F.broadcast(many.where(is_hot)), many.where(~is_hot)
    rows = lines.select("d", "ord", *same)
    met = rows.join(hot, same).union(rows.join(hot, same, "left_anti").join(rest, same).select(*same, "d", "ord", "first", "lines"))
    return met.where(F.struct("d", "ord") != F.col("first")).select("d", "ord"), drop_many


def repeated_lines(documents: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """d, v and places (from 0) of the lines to remove; d is the id (null: the least long), v the text's version."""
    ranks, mask = _ranks(documents)
    # the generator keeps the filter from computing the keys a second time
    keyed = _lines(documents).select("d", "ord", F.explode(F.array(_keys(F.col("line"), ranks, mask))).alias("keys")).where(F.size("keys") >= min_tokens)
    n = F.size("keys")
    lines = keyed.select(
        "d",
        "ord",
        F.xxhash64("keys").alias("set"),
        F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))).alias("parity"),
        n.alias("n"),
        F.slice("keys", 1, n - F.ceil(percent * n / 100).cast("int") + 1).alias("prefix"),
    )
    lines, drop_lines = stored(lines)
    same = ["set", "parity", "n"]  # equal tokens: a hash, and two more facts of the tokens
    classes = lines.groupBy(*same).agg(F.min(F.struct("d", "ord")).alias("first"), F.first("prefix").alias("prefix"))
    # two different sets reach the similarity only if one token more does: n / (n + 1) >= percent / 100
    joined = classes.where(F.col("n") * (100 - percent) >= percent)
    postings = joined.select(F.col("first.d").alias("d"), F.col("first.ord").alias("ord"), "n", "parity", F.posexplode("prefix").alias("i", "key"))
    # a pair's smaller set holds the key in its index prefix; rows without such a partner of near size are left behind
    by_size = Window.partitionBy("key").orderBy("n", "i")
    indexed = F.col("i") < _index_length(F.col("n"), percent)
    larger = 100 * F.col("n") >= percent * F.lead("n").over(by_size)
    smaller = 100 * F.last(F.when(indexed, F.col("n")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1)) >= percent * F.col("n")
    near_size = postings.withColumn("reach", F.coalesce(indexed & larger, F.lit(False)) | F.coalesce(smaller, F.lit(False))).where("reach").drop("reach")
    by_age = Window.partitionBy("key").orderBy("d", "ord")
    row = F.struct("d", "ord", "n", "i", "parity")
    # the second of two meets the first alone
    alone = (F.col("turn") == 2) & F.lead("n").over(by_age).isNull()
    shared = near_size.withColumn("turn", F.row_number().over(by_age)).withColumn("x", F.first(row).over(by_age)).withColumn("alone", alone).where("turn > 1").withColumn("y", row)
    first = F.when(_close("x", "y", percent), F.struct(F.col("x.d").alias("e_d"), F.col("x.ord").alias("e_ord")))
    shared, drop_shared = stored(shared.select("key", "d", "ord", "n", "i", "parity", "alone", first.alias("first")))
    near = _small(cut(_similar(shared.where("first is not null").select("d", "ord", "first.*"), documents, percent)))
    rest = shared.where("not alone").drop("first", "alone")
    left = rest.join(near, ["d", "ord"], "left_anti").withColumnRenamed("key", "k").alias("y")
    earlier = (F.col("x.d") < F.col("y.d")) | ((F.col("x.d") == F.col("y.d")) & (F.col("x.ord") < F.col("y.ord")))
    more = rest.alias("x").join(left, (F.col("key") == F.col("k")) & earlier & _close("x", "y", percent))
    more = more.select("y.d", "y.ord", F.col("x.d").alias("e_d"), F.col("x.ord").alias("e_ord"))
    near = _small(cut(near.union(_similar(more, documents, percent)).distinct()))

    # all but the first line of a class go, and of first lines those that are near an earlier one
    later, drop_many = _later_lines(lines, same, hot_classes)
    gone = later.union(near.select("d", "ord"))
    out = cut(gone.groupBy("d", F.shiftright("ord", 32).alias("v")).agg(F.collect_set(F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("places")))
    for drop in (drop_lines, drop_shared, drop_many):
        drop()
    return out


def drop_repeated_lines(documents: DataFrame, percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """All columns of ``documents`` with the text less its removed lines, plus n_lines and n_removed."""
    gone = _small(repeated_lines(documents, percent, min_tokens).select(F.col("d").alias("_d"), F.col("v").alias("_v"), F.col("places").alias("_places")), F.size("_places"))
    # a row travels whole in one column, so none of its names can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    text = F.col("_row")["text"]
    met = rows.join(gone, (F.coalesce(F.col("_row")["doc_id"], F.lit(_NO_ID)) == F.col("_d")) & (_version(text) == F.col("_v")), "left")
    # the generator keeps the split from being computed for each of its uses; texts that stay as they are pass it by
    met = met.select("_row", "_places", F.explode(F.array(F.when(F.col("_places").isNotNull(), F.split(text, "\n")))).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    left = F.when(F.col("_places").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    other = [F.col("_row")[c].alias(c) if c != "text" else left.alias("text") for c in documents.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(text.isNull(), 0).when(F.col("_places").isNotNull(), F.size("_lines")).otherwise(F.size(F.split(text, "\n")))
    return met.select(*other, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"))
