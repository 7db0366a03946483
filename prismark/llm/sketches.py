"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame operations only.

A paragraph is a line; its digest is 64 bits. A sketch has three tables of cells; each distinct digest is added to one cell
of each table: to its count, to the exclusive or of its digests and to the exclusive or of their checks. Sketches of two
versions subtract cell by cell, and what both have disappears. A cell with count 1 or -1 whose check fits its digest
holds one differing paragraph; it is taken out of its other cells, which may free others. If cells are left that are not
empty, the same is done with sketches four times as large.

Cells are rows: a sketch is one aggregation of the exploded digests by cell, and a round of peeling one explosion and two
aggregations, for all documents at once. So the work is linear in the number of lines, however long a text is. Everything is
dealt out by row once and aggregated where it lies.

The likeness of two fingerprints is the number of shared paragraphs over that of all, by what was recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_next
from .store import durable

TABLES = 3
#: Cells of a table in the smallest sketch, which is the fingerprint; a retry has four times as many.
CELLS = 4
GROWTH = 4
#: Rounds of peeling before a sketch counts as failed; one four times as large takes fewer.
ROUNDS = 6
#: Bytes of text in a range of ids, about, and the most ranges (their ends pass the driver).
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 14


def digests(text: Column) -> Column:
    """The distinct digests of a text's non-empty lines."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _places(digest: Column, cells: int) -> list[Column]:
    """A digest's cell in each table."""
    return [(F.pmod(F.xxhash64(digest, F.lit(t)), F.lit(cells)) + t * cells).cast("int") for t in range(TABLES)]


def _cells(entries: DataFrame, by: list[str], cells: int) -> DataFrame:
    """Sketches of `entries` (by..., n, d): their cells that are not empty, as rows (by..., cell, n, d, x)."""
    placed = entries.select(*by, "n", "d", _check(F.col("d")).alias("x"), F.explode(F.array(*_places(F.col("d"), cells))).alias("cell"))
    return placed.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("x").alias("x"))


def _peel(state: DataFrame, by: list[str], cells: int) -> DataFrame:
    """One round: rows (by..., cell, src, n, d, x), where cell -1 stands for a digest `src` that has been recovered."""
    n, d, x = F.col("n"), F.col("d"), F.col("x")
    entry = lambda cell, src, count: F.struct(cell.cast("int").alias("cell"), src.cast("long").alias("src"), count.cast("long").alias("n"), d.alias("d"), x.alias("x"))
    pure = (F.col("cell") >= 0) & (F.abs(n) == 1) & (_check(d) == x)
    own = entry(F.col("cell"), F.col("src"), n)
    taken = F.array(own, entry(F.lit(-1), d, n), *[entry(p, d, -n) for p in _places(d, cells)])
    moved = state.select(*by, F.explode(F.when(pure, taken).otherwise(F.array(own))).alias("e")).select(*by, "e.*")
    once = moved.groupBy(*by, "cell", "src").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.max("x").alias("x"))  # a digest may be alone in several cells
    kind = F.when(F.col("cell") < 0, F.col("src"))
    left = once.groupBy(*by, "cell", kind.alias("src")).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("x").alias("x"))
    return left.where("cell < 0 or n <> 0 or d <> 0 or x <> 0")


def differences(sets: DataFrame) -> DataFrame:
    """(row, pair, found): the digests that only one of two sets has, from `sets` (row, pair, left, right arrays of digests).

    found is an array of (d, n), n = 1 for those of the left set and -1 for those of the right. Every (row, pair) is
    unique; a null set counts as empty. All differences are recovered by peeling, from sketches that grow until they yield.
    """
    by, level, parts = ["row", "pair"], 0, []
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # asked for by number: what is small here grows when exploded
    signed = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<long>")), lambda d: F.struct(F.lit(n).cast("long").alias("n"), d.alias("d")))
    left = sets
    while True:
        cells = CELLS * GROWTH**level
        entries = left.repartition(tasks, "row").select(*by, F.explode(F.concat(signed("left", 1), signed("right", -1))).alias("e")).select(*by, "e.n", "e.d")
        state = _cells(entries, by, cells).withColumn("src", F.lit(None).cast("long"))
        for _ in range(ROUNDS):
            state = _peel(state.where("cell < 0 or n <> 0 or d <> 0 or x <> 0"), by, cells)
        found = F.when(F.col("cell") < 0, F.struct("d", "n"))
        peeled = durable(state.groupBy(*by).agg(F.max("cell").alias("top"), F.collect_list(found).alias("found")).select(*by, (F.col("top") >= 0).alias("failed"), F.when(F.col("top") < 0, F.col("found")).alias("found")), "peeled")
        parts.append(peeled.where("not failed").select(*by, "found"))
        failed = peeled.where("failed").select(*by)
        if not failed.limit(1).count():
            break
        left, level = left.join(failed, by, "left_semi"), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return sets.select(*by).join(out, by, "left").select(*by, F.coalesce("found", F.array().cast("array<struct<d:bigint,n:bigint>>")).alias("found"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared over all, from the sizes of two sets and the number of differences."""
    both = a + b
    return F.when(both == 0, 1.0).otherwise((both - differing) / (both + differing))


def fingerprints_of(sets: DataFrame) -> DataFrame:
    """(row, side, fingerprint) of `sets` (row, side, found): the cells of the smallest sketch that are not empty, as text.

    Each is its number, count, digests and checks in hexadecimal. Equal sets have equal ones, an empty set the empty text.
    """
    by = ["row", "side"]
    entries = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row").select(*by, F.explode("found").alias("d")).withColumn("n", F.lit(1).cast("long"))
    cell = F.struct("cell", "n", "d", "x")
    listed = _cells(entries, by, CELLS).groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    told = lambda c: F.concat(F.hex(c.cell), F.lit(":"), F.hex(c.n), F.lit(":"), F.lpad(F.hex(c.d), 16, "0"), F.lpad(F.hex(c.x), 16, "0"))
    return listed.select(*by, F.array_join(F.transform("cells", told), " ").alias("fingerprint"))


def fingerprints(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document, by descending id; the first follows the last. Null counts as empty; empty texts have no paragraphs, and two
    of them have likeness 1. Rows with one id follow each other by text, and rows with a null id are placed below all
    others; rows of one id are sorted in one task. An only row is its own next. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = with_next(rows, "at", "text", parts)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.col("text"), F.col("next"), edited.alias("edited"))
    rows = durable(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next")).alias("c")), "digests")
    pair = lambda name, other: F.struct(F.lit(name).alias("pair"), F.col("a").alias("left"), F.col(other).alias("right"))
    sets = rows.select("row", F.explode(F.array(pair("edited", "b"), pair("next", "c"))).alias("p")).select("row", "p.*")
    differing = differences(sets).groupBy("row").agg(*[F.max(F.when(F.col("pair") == x, F.size("found"))).alias(f"differing_{x}") for x in ("edited", "next")])
    side = lambda name, found: F.struct(F.lit(name).alias("side"), F.col(found).alias("found"))
    prints = fingerprints_of(rows.select("row", F.explode(F.array(side("a", "a"), side("b", "b"))).alias("p")).select("row", "p.*"))
    prints = prints.groupBy("row").agg(*[F.max(F.when(F.col("side") == x, F.col("fingerprint"))).alias(f"print_{x}") for x in "ab"])
    sizes = rows.select("row", "doc_id", "n_chars", "edited_sha256", *[F.size(x).alias(f"n_{x}") for x in "abc"])
    joined = sizes.join(differing, "row").join(prints, "row", "left")
    a, b, c = F.col("n_a"), F.col("n_b"), F.col("n_c")
    return joined.select("doc_id", "n_chars", "edited_sha256", F.coalesce("print_a", F.lit("")).alias("fingerprint"), F.coalesce("print_b", F.lit("")).alias("edited_fingerprint"), likeness(a, b, F.col("differing_edited")).alias("near_edited"), likeness(a, c, F.col("differing_next")).alias("near_next"))


#: Without the sketches, what SQL can say of the same rows.
EDITED_SQL = """
SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(substr(coalesce(text, ''), 1, length(coalesce(text, '')) - length(coalesce(text, '')) // 3)
  || substr(coalesce(lead(text) OVER w, first_value(text) OVER w, ''), 1, length(coalesce(text, '')) // 3)) AS edited_sha256
FROM documents WINDOW w AS (ORDER BY doc_id DESC)"""
