"""From raw documents to a clean, mixed corpus: each stage works on what the one before kept.

``run`` writes the result of every stage to the shared folder and reads it again, so a lost
executor never sends the work further back than the stage it was in.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from appcensus.llm import exact_dedup, mixing, ngram_join, quality_rules, tree_bpe
from appcensus.llm.tables import documents, new_path, written


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    return exact_dedup.keep_one_of_table(docs, index)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as digests, with those of the text they decode to."""
    return tree_bpe.round_trip(docs, tree_bpe.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_poor),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("tree_bpe", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
