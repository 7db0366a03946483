"""Edges of images as tables: gradients, runs, components, ellipses, Hough votes, corners."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import durable


def runs(cells: DataFrame, least_span: int = 3, keys: tuple[str, ...] = ("view_id", "r"), at: str = "c") -> DataFrame:
    """(keys, x1, x2): runs of consecutive `at` in each row of an edge mask that span at least `least_span`.

    Repeated cells count once. Whether ends are inclusive is our choice: x1 and x2 are the first and last cell.
    """
    cells = cells.select(*keys, at).where(F.col(at).isNotNull()).distinct()
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return cells.withColumn("island", island).groupBy(*keys, "island").agg(F.min(at).alias("x1"), F.max(at).alias("x2")).where(F.col("x2") - F.col("x1") >= least_span).drop("island")


def drawing_segments(found: DataFrame, height: int, conf: float = 1.0) -> DataFrame:
    """Runs (view_id, r, x1, x2) as segments with y upwards, by our choice y = height - r."""
    y = (F.lit(height) - F.col("r")).cast("double")
    return found.select("view_id", F.col("x1").cast("double").alias("x1"), y.alias("y1"), F.col("x2").cast("double").alias("x2"), y.alias("y2"), F.lit(conf).alias("conf"))


#: The Sobel kernels as (row offset, column offset, weight across, weight down).
SOBEL = tuple((dr, dc, dc * (2 if dr == 0 else 1), dr * (2 if dc == 0 else 1)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)


def sobel(pixels: DataFrame) -> DataFrame:
    """(view_id, r, c, gx, gy, magnitude) of pixels (view_id, r, c, g) that have all eight neighbours.

    Each pixel is scattered to its neighbours and summed there: one partial aggregation, no self-join.
    """
    scattered = pixels.select("view_id", "r", "c", "g", F.explode(F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(wx)).alias("wx"), F.lit(float(wy)).alias("wy")) for dr, dc, wx, wy in SOBEL])).alias("k"))
    at = scattered.groupBy("view_id", (F.col("r") + F.col("k.dr")).alias("r"), (F.col("c") + F.col("k.dc")).alias("c")).agg(F.sum(F.col("g") * F.col("k.wx")).alias("gx"), F.sum(F.col("g") * F.col("k.wy")).alias("gy"), F.count("*").alias("n"))
    return at.where("n = 8").select("view_id", "r", "c", "gx", "gy", F.hypot("gx", "gy").alias("magnitude"))


def edges(pixels: DataFrame, threshold: float) -> DataFrame:
    return sobel(pixels).where(F.col("magnitude") >= threshold)


def corners(pixels: DataFrame, threshold: float, k: float = 0.04) -> DataFrame:
    """(view_id, r, c, response, desc): local maxima of the Harris response, by our choice of detector.

    The descriptor is the eight neighbours' gradients, row by row, which the detector has at hand.
    """
    g = sobel(pixels)
    near = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])).alias("k")
    spread = g.select("view_id", "r", "c", "gx", "gy", near)
    at = [(F.col("r") + F.col("k.dr")).alias("r"), (F.col("c") + F.col("k.dc")).alias("c")]
    m = spread.groupBy("view_id", *at).agg(F.sum(F.col("gx") ** 2).alias("xx"), F.sum(F.col("gy") ** 2).alias("yy"), F.sum(F.col("gx") * F.col("gy")).alias("xy"), F.array_sort(F.collect_list(F.struct((-F.col("k.dr")).alias("dr"), (-F.col("k.dc")).alias("dc"), "gx", "gy"))).alias("patch"), F.count("*").alias("n")).where("n = 9")
    response = F.col("xx") * F.col("yy") - F.col("xy") ** 2 - k * (F.col("xx") + F.col("yy")) ** 2
    m = m.select("view_id", "r", "c", response.alias("response"), F.flatten(F.transform("patch", lambda p: F.array(p.gx, p.gy))).alias("desc")).where(F.col("response") > threshold)
    around = m.select("view_id", "response", "r", "c", near).select("view_id", *at, F.struct("response", (-F.col("r")).alias("r"), (-F.col("c")).alias("c")).alias("x"))
    best = around.groupBy("view_id", "r", "c").agg(F.max("x").alias("x"))
    return m.join(best, ["view_id", "r", "c"]).where((F.col("x.r") == -F.col("r")) & (F.col("x.c") == -F.col("c"))).drop("x")


#: Runs of a view that one task takes whole, and runs of many views that it takes together, about.
WHOLE, TOGETHER = 1 << 17, 1 << 15


def edge_components(cells: DataFrame, rounds: int = 64) -> DataFrame:
    """(view_id, r, c, component): 8-connected components of edge cells, by least cell; connectivity is our choice.

    Runs within rows are found first, so that the iteration is over runs, not cells. Views of up to `WHOLE` runs are dealt to groups of views, each one task's
    work; the runs of larger ones are linked by joins, in rounds.
    """
    spans = durable(runs(cells, 0).withColumn("node", F.xxhash64("view_id", "r", "x1")), "runs")
    large = durable(spans.groupBy("view_id").agg(F.count("*").alias("n")).where((F.col("n") > WHOLE) & F.col("view_id").isNotNull()).select("view_id"), "large")
    some = bool(large.limit(1).count())
    rest = spans.join(large, "view_id", "left_anti") if some else spans
    group = F.pmod(F.xxhash64("view_id", F.lit("group")), F.lit(spans.count() // TOGETHER + 1))
    labelled = rest.withColumn("group", group).groupBy("group").applyInArrow(_labelled, StructType([*spans.schema.fields, StructField("component", LongType())]))
    if some:
        labelled = labelled.unionByName(_linked(spans.join(large, "view_id", "left_semi"), rounds).select(*labelled.columns))
    return labelled.select("view_id", "r", F.explode(F.sequence("x1", "x2")).alias("c"), "component")


def _labelled(table):
    """Runs of some whole views with the least node that each run reaches; runs without a view or row touch none."""
    import numpy as np
    import pyarrow as pa

    table = table.drop_columns(["group"])
    whole = lambda c: c.fill_null(0).cast(pa.int64()).to_numpy()
    r, x1, x2, node = (whole(table.column(c)) for c in ("r", "x1", "x2", "node"))
    view = table.column("view_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    view = np.where(table.column("r").is_null().to_numpy(), -1, view)
    order = np.lexsort((x1, r, view))
    v, r, a1, a2 = view[order], r[order], x1[order], x2[order]
    new = np.append(True, (np.diff(v) != 0) | (np.diff(r) != 0))
    row = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    follows = np.append((np.diff(v[head]) == 0) & (np.diff(r[head]) == 1), False) & (v[head] >= 0)
    low, width = a1.min(), a2.max() - a1.min() + 4
    own = np.flatnonzero(follows[row])
    at = (row[own] + 1) * width - low
    first, last = np.searchsorted(row * width + a2 - low, at + a1[own] - 1, "left"), np.searchsorted(row * width + a1 - low, at + a2[own] + 1, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(own, n)
    b = np.repeat(first, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    a, b = order[a], order[b]
    by = np.argsort(node, kind="stable")
    label = np.empty(len(node), np.int64)
    label[by] = np.arange(len(node))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = np.minimum(label, label[by[label]])
        if (label == before).all():
            return table.append_column("component", pa.array(node[by[label]]))


def _linked(spans: DataFrame, rounds: int) -> DataFrame:
    """Runs with the least node that each reaches, however many runs a view has."""
    from .graphs import connected

    a, b = spans.alias("a"), spans.alias("b")
    touch = a.join(b, (F.col("a.view_id") == F.col("b.view_id")) & (F.col("a.r") + 1 == F.col("b.r")) & (F.col("a.x1") <= F.col("b.x2") + 1) & (F.col("b.x1") <= F.col("a.x2") + 1))
    labels = connected(touch.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), rounds)
    return spans.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def ellipses(cells: DataFrame, keys: tuple[str, ...] = ("view_id", "component"), x: str = "c", y: str = "r", least: int = 3) -> DataFrame:
    """(keys, n, cx, cy, major, minor, angle) of point sets by their covariance.

    Half axes are those of an outline of the same covariance, sqrt(2 * eigenvalue); the angle, in radians, is the major axis's.
    """
    m = cells.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy")).where(F.col("n") >= least)
    half, root = (F.col("sxx") + F.col("syy")) / 2, F.sqrt(((F.col("sxx") - F.col("syy")) / 2) ** 2 + F.col("sxy") ** 2)
    return m.select(*keys, "n", "cx", "cy", F.sqrt(2 * (half + root)).alias("major"), F.sqrt(2 * F.greatest(F.lit(0.0), half - root)).alias("minor"), (F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2).alias("angle"))


def hough_votes(points: DataFrame, angles: int = 18, rho_bin: float = 10.0, x: str = "c", y: str = "r", keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """(keys, theta, rho_bin, votes): each point votes once for every angle; theta counts steps of pi / angles.

    Sines and cosines are literals, so all of it stays in generated code; votes are summed before they are shuffled.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(round(math.cos(k * math.pi / angles), 12)).alias("cos"), F.lit(round(math.sin(k * math.pi / angles), 12)).alias("sin")) for k in range(angles)])
    votes = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(steps).alias("s"))
    rho = F.floor((F.col("x") * F.col("s.cos") + F.col("y") * F.col("s.sin")) / rho_bin + 1e-9).cast("long")
    return votes.groupBy(*keys, F.col("s.theta").alias("theta"), rho.alias("rho_bin")).agg(F.count("*").alias("votes"))


def top_k(rows: DataFrame, order: list, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows, of each key if there are any; `order` must break every tie."""
    if not keys:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__at") <= k).drop("__at")


def dominant_lines(points: DataFrame, k: int = 8, **options) -> DataFrame:
    keys = options.get("keys", ("view_id",))
    return top_k(hough_votes(points, **options), [F.desc("votes"), "theta", "rho_bin"], k, keys)
