"""Exact deduplication by deterministic block naming, with DataFrame operations only.

A text without white space is cut into blocks of `BLOCK` bytes. Distinct blocks are sorted into integer names;
then each adjacent pair of names is named in the same way, again and again, until every document has one name.
Names are equal exactly if the contents are: a name stands for one content, which is checked on the blocks
themselves, never assumed of a hash.

Blocks travel once, as distinct contents, for that check; everything else moves the 128-bit keys by which they are
sorted. Should two contents share a key, the keys are made anew with another seed.

Copies are gathered before anything is named: rows are aggregated by their keys within slices, then over them, so each distinct
document is named once and a third of all rows in one group meets nowhere. What is decided goes back by the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, durable, looked_up, rows_kept

BLOCK = 4096
#: Space and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _blocks(content: Column) -> Column:
    """The blocks of a binary column, at least one."""
    whole = F.array(content)  # so that it is computed once
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(b) - 1) / BLOCK)).cast("int")), lambda i: F.substring(b, i * BLOCK + 1, F.lit(BLOCK)))
    return F.element_at(F.transform(whole, cut), 1)


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(block, F.lit(seed)).alias("k1"), F.xxhash64(F.lit(seed), block, F.lit("second")).alias("k2"))


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct `keys` with an integer each, by their place in sorted order."""
    order = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return durable(order.withColumn("name", F.monotonically_increasing_id()), "names")


def _identities(kinds: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, level, name): the one name of each document of `kinds` (kind, keys), after the level at which one was left."""
    parts = kinds.select("kind", F.size("keys").alias("size"), F.posexplode("keys").alias("place", "k")).select("kind", "size", "place", "k.k1", "k.k2")
    parts = durable(looked_up(parts, names.select("k1", "k2", "name"), ["k1", "k2"], ["kind", "place"]).select("kind", "size", "place", "name"), "parts")
    done, level = None, 0
    while True:
        ready = parts.where("size = 1").select("kind", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        rest = parts.where("size > 1")
        if not rest.limit(1).count():
            return done
        half = F.shiftright("place", 1)
        pairs = durable(rest.groupBy("kind", half.alias("place"), F.shiftright(F.col("size") + 1, 1).alias("size")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        named = _named(pairs.groupBy("left", "right").agg(F.count("*").alias("uses")), ["left", "right"])
        parts = durable(looked_up(pairs, named.select("left", "right", "name"), ["left", "right"], ["kind", "place"]).select("kind", "place", "size", "name"), "parts")
        discard(pairs)
        discard(named)
        level += 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too; with `row_col`, a key of the rows, that too.

    Texts are equal if they are identical without white space (space and 9-13). Of equal texts the row with the most
    code points stays, then the smallest doc_id, a null one before all; of rows that agree in both, one. Null counts as empty,
    and all texts without other characters are equal. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select((F.col(row_col) if row_col else F.lit(None).cast("string")).alias("given"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = normalised(F.col("text")).cast("binary")
    seed = 0
    while True:
        blocks = texts.select(F.explode(_blocks(plain)).alias("block"))
        distinct = blocks.select(_key(F.col("block"), seed).alias("k"), "block").select("k.k1", "k.k2", "block").groupBy("k1", "k2", "block").agg(F.lit(1).alias("one"))
        contents = distinct.groupBy("k1", "k2").agg(F.count("*").alias("contents"))
        names = _named(contents, ["k1", "k2"])
        if not names.where("contents > 1").limit(1).count():
            break
        discard(names)
        seed += 1
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(
        texts.select("given", "doc_id", F.length("text").alias("n_chars"), F.array(plain).alias("whole"))
        .select("given", "doc_id", "n_chars", F.element_at(F.transform("whole", lambda b: F.struct(F.sha2(b, 256).alias("sha"), F.transform(_blocks(b), lambda x: _key(x, seed)).alias("keys"))), 1).alias("x"))
        .select(F.monotonically_increasing_id().alias("row"), "given", "doc_id", "n_chars", F.col("x.sha").alias("text_sha256"), F.col("x.keys").alias("keys")),
        "rows",
    ).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    first = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    partial = durable(rows.groupBy("keys", "slice").agg(F.count("*").alias("n"), F.min(first).alias("first")), "slices")
    kinds = durable(partial.groupBy("keys").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("kind", F.monotonically_increasing_id()), "kinds")

    groups = kinds.select("kind", "keys", "n", "first").join(_identities(kinds.select("kind", "keys"), names), "kind")
    sizes = groups.groupBy("level", "name").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"))
    decided = groups.select("keys", "level", "name").join(sizes, ["level", "name"]).select("keys", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    back = partial.select("keys", "slice").join(decided, "keys")
    out = rows.join(back, ["keys", "slice"]).select("given", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return out.withColumnRenamed("given", row_col) if row_col else out.drop("given")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    One row of each group of equal texts stays, by the rule of `exact_duplicates`; null and empty texts are such a group. Rows
    without an id and rows with the same id are told apart. An empty table stays empty; other columns are carried, not looked at.
    """
    return rows_kept(docs, lambda named: exact_duplicates(named, row_col="name").where("kept"))


ORACLE_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
ranked AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM plain
  WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked"""
