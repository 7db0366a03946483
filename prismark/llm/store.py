"""Intermediate tables that outlive executors, names for rows that have none, and joins with frequent keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, durable, shared_root

__all__ = ["batches_of", "discard", "durable", "joined", "looked_up", "rows_kept", "shared_root"]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at a time from the jobs that run inside; afterwards as many as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _named_rows(docs: DataFrame) -> DataFrame:
    """(own, name): each row as a struct, and its name: its file and its place there, the same at every reading."""
    return docs.select(F.struct("*").alias("own"), F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("name"))


def rows_kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The rows of `docs` whose names are in `decide`'s result (name), with all their columns, whatever these are called.

    `decide` gets the `columns` and a name for each row, also for equal ones and those without an id. Rows of stored tables
    are named by file and place; other tables are stored first.
    """
    try:
        named = _named_rows(docs)
    except AnalysisException:  # not a table of files
        named = _named_rows(durable(docs, "rows"))
    kept = decide(named.select(*[F.col("own").getField(c).alias(c) for c in columns], "name"))
    return named.join(kept.select("name"), "name", "left_semi").select("own.*")


def looked_up(rows: DataFrame, names: DataFrame, on: Sequence[str], row: Sequence[str]) -> DataFrame:
    """`rows` inner joined with `names`, which has each key `on` once, where one key may have any share of the rows.

    Rows are dealt into as many slices as there are shuffle partitions, by their columns `row`. A key travels to each slice that
    has rows of it, found by an aggregation that combines before it shuffles; then rows meet it by key and slice.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*row), F.lit(slices)).cast("int"))
    wanted = sliced.groupBy(*on, "__slice").agg(F.lit(1).alias("__one")).drop("__one")
    return sliced.join(wanted.join(names, list(on)), [*on, "__slice"]).drop("__slice")


def joined(docs: DataFrame, labels: DataFrame, *columns) -> DataFrame:
    """`columns` of all `docs` that have a label, stored. Labels are stored first, so Spark broadcasts them only if they are small."""
    labels = durable(labels, "labels")
    rows = durable(docs.select("doc_id", "text").join(labels, "doc_id").select(*columns), "labelled")
    discard(labels)
    return rows
