"""From raw documents to encoded training text, each stage on all that the one before it kept.

A null text counts as an empty one throughout. All empty and blank texts are copies of each other, of which one stays; it has
no words, so that mixing takes it no more often than its source's rate says, and no pieces. Documents with a null id are
scored like others, are the last choice among exact copies, are linked with nothing as near copies, and are drawn by an empty
id. Of repeated rows one stays. Columns that the table has besides are carried up to the encoding. Empty tables give an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, mixing, near_dedup, sentencepiece_wfst, toxicity
from factloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside its held-out fifth, takes for toxic go."""
    return toxicity.accepted(docs, toxicity.fit_tables(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space one stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (runs of five words, similarity 0.8) one stays."""
    return near_dedup.near_deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's text. The null text has none."""
    out = sentencepiece_wfst.encode(docs, sentencepiece_wfst.compile_model())
    return out.select("doc_id", "lang", "source", "piece_ids", "n_pieces", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
