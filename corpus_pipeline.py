"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes each
stage's rows as Parquet in the shared checkpoint folder, reads them again, and takes
every table away once the next one is there.

Defined results, for every stage: other columns than those of ``documents`` go, so
none can clash; an empty table stays empty; texts of any length are taken whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import language_id, line_dedup, mixing, ngram_join, packing
from larkspur.llm._common import cut, removed, shared_folder, table
from larkspur.llm.queries import word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go, null texts and texts without a letter among them; repeated rows go or stay together."""
    return language_id.identify(docs, language_id.fit(docs)).where("not rejected").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line go; documents stay, with n_chars of what is left.

    Null texts stay null; null ids come first; repeated rows are one document and come out alike.
    """
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 Jaccard similarity of five-word shingles, the smallest doc_id stays, once.

    Documents without words are groups of their own and stay; rows without an id stay
    unless all of them are like rows with one; rows that repeat an id and text stay once.
    """
    found = ngram_join.link_components(docs, 5, 80)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = cut(found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows")))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = docs.join(counted(ids.where("not stays")), same, "left_anti").select(*COLUMNS)
    repeated = ids.where("stays and rows > 1").select("_id")
    if repeated.isEmpty():
        return kept
    repeated = counted(repeated)
    return kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def counted(ids: DataFrame) -> DataFrame:
    """Ids marked for broadcast if there are few enough; more are joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= ngram_join.BROADCAST_IDS else ids


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the mix takes them; one taken in part stays if half of it is.

    A null source is one of its own; documents without words are taken by no quota; repeated rows each count.
    """
    mixed = mixing.mix(docs.withColumn("size", word_count()))
    copies = F.col("whole_turns") + F.when((F.col("part_words") > 0) & (2 * F.col("part_words") >= F.col("size")), 1).otherwise(0)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their place in sequences of at most 4096 tokens; a null text is its end token alone, repeated rows are packed each."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The classifier and the tokenizer cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            removed(spark, f"{top}/{k - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are checkpointed, so no table is read from here on
    removed(spark, top)
    return packed
