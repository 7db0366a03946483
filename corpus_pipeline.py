"""A training corpus out of `documents`: five stages, each written as Parquet and read by the next.

Toxic documents go; of texts that are equal without white space one stays; of each group of near copies (five-word
shingles, similarity 0.8 or more) one stays; good and poor text are mixed to target weights, by repeating documents and
dropping none; whole texts are packed into sequences of 4096 tokens.

Every stage takes null and empty texts, rows without an id, repeated rows, empty tables and further columns of any name; what
becomes of them is told at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismark.llm import blocks, minhash, mixing, packing, supervision, toxicity
from prismark.llm.queries import table, vocabulary
from prismark.llm.store import durable

#: Shares of the mixture's tokens by domain; the check tables have about 0.83 and 0.17 of them, so good text is repeated by about a fifth.
TARGETS = {"good": 0.86, "poor": 0.14}


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Null and empty texts stay; equal texts stay or go together. Without labels of both kinds all rows stay. Learned from all labelled rows outside fold 1 of 3."""
    return toxicity.without_toxic(docs, supervision.train(docs, table(spark, folder, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of null texts, empty ones and white space, which are equal, one row stays; rows are told apart by place, so ids may be null or repeated."""
    return blocks.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without words stay. Rows with one id are one document; of alike rows without an id one stays."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """No row goes; rows with one id, and all rows without one, are repeated alike. Domains are learned from all labelled rows. Targets out of reach are told by a warning."""
    domains = mixing.fit_domains(docs, mixing.domain_labels(table(spark, folder, "labels")), list(TARGETS), sample_rows=None)
    return mixing.remixed(docs, domains, TARGETS, vocabulary(), repeat_only=True)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows of pieces, no longer of documents; a null or empty text is its end token alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL cannot express a learned classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
