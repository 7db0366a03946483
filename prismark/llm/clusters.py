"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors with their multiplicities.

Identical quantised vectors are counted once, with a number of copies each; every round reads only the distinct ones and adds up
weighted integers, so sums are exact and do not depend on how rows are dealt. Only K centroids pass through the driver. At the end the
rows find their vector's cluster by a 128-bit key, whose one-to-one relation with the vectors is checked, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, durable, looked_up

#: Quantised components are held within this bound, and distances and inertias within that of a long.
FARTHEST, LONGEST = 1 << 62, (1 << 63) - 1
SCHEMA = "vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), F.lit(float(scale)) * x.cast("double")))))


def usable(vector: Column, dims: int) -> Column:
    """Exactly `dims` components, none null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (F.size(vector) == dims) & F.coalesce(fine, F.lit(False))


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each point's nearest centroid, exact; ties go to the smaller number."""
    most = max(int(np.abs(points).max(initial=0)), max(abs(x) for c in centroids for x in c))
    if 4 * points.shape[1] * most * most < 1 << 53:  # every sum below is an integer that a double holds
        x, c = points.astype(np.float64), np.array(centroids, np.float64)
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        best = d.argmin(1)
        return best.astype(np.int32), d[np.arange(len(d)), best].astype(np.int64)
    x = points.astype(object)
    d = np.stack([((x - np.array(c, object)) ** 2).sum(1) for c in centroids], 1)
    best = np.array([min(range(len(r)), key=lambda k: (r[k], k)) for r in d], np.int32)
    return best, np.array([min(r[k], LONGEST) for r, k in zip(d, best)], np.int64)


def _points(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(centroids: list[list[int]], dims: int):
    """Of each task: copies (at dim -1) and weighted component sums by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 1) for _ in centroids]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _points(batch, dims), batch.column("n").to_numpy()
            best, _ = nearest(x, centroids)
            safe = int(np.abs(x).max(initial=0)) * int(n.sum()) < 1 << 62
            for c in np.unique(best):
                own = best == c
                w = n[own] if safe else n[own].astype(object)
                sums = (x[own] * w[:, None]).sum(0)
                total[c] = [a + int(b) for a, b in zip(total[c], [w.sum(), *sums])]
        rows = [(c, d - 1, v) for c, row in enumerate(total) if row[0] for d, v in enumerate(row)]
        c, d, v = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(v, pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    return run


def _assigned(centroids: list[list[int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_points(batch, dims), centroids) if batch.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("n"), pa.array(best), pa.array(distance)], names=["k1", "k2", "n", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int, dims: int) -> list[list[int]]:
    """Centroids after so many rounds over `distinct` (n, q); it ends earlier when a round moves none, as no later one would."""
    for _ in range(rounds):
        sums = distinct.select("n", "q").mapInArrow(_sums(centroids, dims), "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()
        of = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums}
        moved = [[of[c, d] // of[c, -1] for d in range(dims)] if (c, -1) in of else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row whose vector is usable.

    Vectors that are null, of another length, or have a null or not finite component are left out. Centroids start as the vectors of
    the k smallest sha256 of `salt:vec_id`; rows with one id in the order of their vectors, rows without an id after all others, so
    with fewer than k rows there are fewer clusters. Rows with equal ids stay apart, as do copies. Components beyond 2^62 count as 2^62,
    and distances and inertias beyond a long as the greatest long. An empty table, or one of unusable vectors, gives an empty result;
    other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"))
    seed = 0
    while True:
        keyed = kept.select("vec_id", F.xxhash64("q", F.lit(seed)).alias("k1"), F.xxhash64(F.lit(seed), "q", F.lit("second")).alias("k2"), "q")
        distinct = durable(keyed.groupBy("k1", "k2", "q").agg(F.count("*").alias("n")), "vectors")
        if not distinct.groupBy("k1", "k2").agg(F.count("*").alias("vectors")).where("vectors > 1").limit(1).count():
            break
        discard(distinct)
        seed += 1
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select(order.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    if not starts:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(kind=kind))
    centroids = lloyd(distinct, [list(r["q"]) for r in starts], rounds, dims)
    final = durable(distinct.mapInArrow(_assigned(centroids, dims), "k1 long, k2 long, n long, cluster int, distance long"), "assigned")
    discard(distinct)
    weight = F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    inertia = {r["cluster"]: int(r["inertia"]) for r in final.groupBy("cluster").agg(F.sum(weight.cast("decimal(38,0)")).alias("inertia")).collect()}
    each = F.array(*[F.lit(min(inertia.get(c, 0), LONGEST)).cast("long") for c in range(len(centroids))])
    digest = F.array(*[F.sha2(F.lit(",".join(map(str, c))).cast("binary"), 256) for c in centroids])
    rows = durable(keyed.select(F.monotonically_increasing_id().alias("row"), "vec_id", "k1", "k2"), "rows")
    found = looked_up(rows, final.select("k1", "k2", "cluster", "distance"), ["k1", "k2"], ["row"])
    at = F.col("cluster") + 1
    return found.select("vec_id", "cluster", "distance", F.element_at(each, at).alias("cluster_inertia"), F.lit(min(sum(inertia.values()), LONGEST)).cast("long").alias("inertia"), F.element_at(digest, at).alias("centroid_sha256"))


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same over `embeddings`, its rounds written out one after another."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dims}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('{salt}:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, min(o) AS best FROM (
    SELECT vec_id, p.q, {{'d': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.q, c.q)]) AS BIGINT), 'c': c}} AS o FROM kept p, c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT best.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}),
m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM s{r} GROUP BY c, i),
f{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(f.q, o.q) AS q FROM c{r} o LEFT JOIN f{r} f USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""
