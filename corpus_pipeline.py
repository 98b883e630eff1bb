"""A training-corpus pipeline of five stages over the documents table.

Each stage is one corpus operator applied to all that its predecessor kept. All
but the last return the columns of documents, and their decisions are in what they
return: rejected and duplicate documents are gone, personal data is replaced,
and a document that the mix repeats is there as often as it is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gumbel_pieces, mixing, near_dup, pii, quality_gam
from tidemark.llm.common import Scratch, read, spare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; the score column goes again."""
    source = read(spark, sf_dir, "documents")
    model = quality_gam.train(source.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model, "_quality").where(F.col("_quality") >= quality_gam.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    A row without doc_id goes by a hash of its text, and rows that share an id but not the text by one
    of both, so they are documents of their own. Of rows that share id and text and have words one
    stays; documents without words stay, all of them.
    """
    key, several = spare(docs, "key", "several")
    one = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(53)))
    text = F.xxhash64("text", F.lit(59))
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("_low"), F.max(text).alias("_high")).where("_low <> _high").select("doc_id", F.lit(True).alias(several))
    keyed = docs.withColumn(key, one)
    if not shared.isEmpty():
        keyed = docs.join(shared, "doc_id", "left").withColumn(key, F.when(F.col(several), F.xxhash64("doc_id", "text", F.lit(61))).otherwise(one)).select(*docs.columns, key)
    groups = Scratch(spark, "groups").save(near_dup.near_groups(keyed.select(F.col(key).alias("doc_id"), "text")), "groups").where("n_shingles > 0")
    rest = keyed.join(groups.where("not kept").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    twice = groups.where("kept").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key)
    if not twice.isEmpty():
        rest = rest.join(twice, key, "left_anti").select(*docs.columns, key).union(rest.join(twice, key, "left_semi").dropDuplicates([key]).select(*docs.columns, key))
    return rest.select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    done = pii.replace_entities(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take are gone.

    Rows that repeat id and text share their copies: one of them stands for all.
    """
    taken = mixing.mix_sources(docs).groupBy("doc_id", "h").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("rows"))
    taken = Scratch(spark, "taken").save(taken, "taken")
    key = docs.withColumn("_h", mixing.row_key(F.col("doc_id"), F.col("text")))
    if not taken.where("rows > 1").isEmpty():
        key = key.dropDuplicates(["doc_id", "_h"])
    t = taken.where("repeats > 0").alias("t")
    both = key.alias("d").join(t, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d._h") == F.col("t.h")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t.repeats").cast("long")))).select(*[F.col(f"d.{c}") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document as piece ids, with their scores."""
    got = gumbel_pieces.encode_samples(docs.select("doc_id", "text"))
    return got.select("doc_id", "sample", "ids", F.size("ids").alias("n_pieces"), "log_prob", "log_inclusion")


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_personal_data),
    ("mix_to_target_weights", mix_to_targets),
    ("sentencepiece_encoding", encode),
]

#: Sampling, hashing and trained models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
