"""From raw documents to a training mix: toxic documents go, repeated runs of lines go, one of each group of near duplicates stays, benchmark passages go, sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomledger.llm import decontamination, line_dedup, mixing, near_duplicates, toxicity
from loomledger.llm.common import cut, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is trained on the labels that aren't held out. Rows without an id or a text are scored like all others."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that occurred before go; a document that only repeats others goes with them."""
    return line_dedup.dedup_lines(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 75 hundredths of shared five-word shingles, the one with the smallest id stays; rows without an id stay."""
    return near_duplicates.drop_near_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by their sources' target weights: the last stage, whose rows are the mix."""
    return mixing.mix(docs)


#: Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.
STAGES = [
    ("toxicity", _toxicity),
    ("line dedup", _line_dedup),
    ("n-gram jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontaminate),
    ("mixing to target weights", _mix),
]

#: A trained model and iterated joins: SQL can't express this; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents` of a folder; what a stage gives is written as a table and read again. An empty table gives an empty mix."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
