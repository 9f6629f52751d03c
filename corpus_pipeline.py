"""A training corpus from the table of documents: five stages, each over all that the one before has kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, mixing of sources, token-ID files. All
stages but the last return the columns of documents; the last one returns a row per document of its files.

Nulls and edge cases: an empty table passes all stages and gives no rows. Null and empty texts are scored by their
structure, are no near duplicates of each other (those without an id stay once), hold no passage, have size 0 and
are taken as often as their source's rate says, and are one end token in the files. Rows that share an id go through
the join together, equal ones among them once; rows without an id stay where their component has none with one; a
null source is a source of its own. Very long texts are read whole in every stage, and ties have the order that each
operator states. Other columns, whatever their names, stay with their rows up to the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.lineage import cut, discard, release, scratch, small_batches, written
from tessera.llm import decontamination, mixing, ngram_join, quality_classifier, ragged, token_files
from tessera.llm.queries import ENCODED, table, vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    found = quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))
    ragged.give_back()  # what the fit has taken on the driver
    return found


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the token files of the mix, as read back."""
    small_batches(spark)
    return token_files.round_trip(docs, vocabulary(ENCODED))


STAGES = [("quality classifier", good), ("n-gram Jaccard join", unlike), ("benchmark decontamination", untested), ("mixing sources", mixed), ("token files", tokens)]

#: The stages learn, hash and join in ways that SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is a table before the next one reads it."""
    own = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}", own)
        release(spark)
    found = cut(STAGES[-1][1](spark, docs, sf_dir))
    discard(spark, own)
    return found
