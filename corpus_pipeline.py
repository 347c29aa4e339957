"""The corpus pipeline: a stage for each of five operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm.common import table, written
from sheafwork.llm.decontamination import find_leaks
from sheafwork.llm.mixing import take_mixed
from sheafwork.llm.quality import keep_quality
from sheafwork.llm.sharding import assign_shards
from sheafwork.llm.simhash import Similar, similar_dedup

#: Shares of expected tokens in the mixture, whose whole is what makes the good ones' share as many as they are now.
TARGETS = {"good": 0.998, "poor": 0.0, "toxic": 0.002}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest identifier.

    Candidates: fingerprints of shingles of five words within 2 bits, by covering masks, and 42 bands of min-wise hashes of the
    same shingles. Decision: a Jaccard similarity of 0.8 or more of these shingles' sets.
    """
    return similar_dedup(docs, radius=2, similar=Similar(shingle=5, least=0.8))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in occurrences of ten consecutive benchmark words go, and the rest of the document stays."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), window=10, keep=docs.columns, clean=True, prefix="__leak_")
    hit = F.col("__leak_n_hit") > 0
    changed = {"text": F.col("__leak_clean_text"), "n_chars": F.when(hit, F.char_length("__leak_clean_text").cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says: good ones once, toxic and poor ones as far as their targets reach, others by their posteriors."""
    return take_mixed(docs, table(spark, sf_dir, "labels"), TARGETS, anchor="good", tolerance=2e-4)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs, 40)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", mixing_to_targets),
    ("sharding", sharding),
]

#: The fitted models and near-duplicate groups can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
