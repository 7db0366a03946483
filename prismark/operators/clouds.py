"""Segmentation of point clouds: smooth parts grown over the cells of a grid."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import discard, durable
from .geometry import principal_axes
from .graphs import connected

_CELL = ("__cloud", "__i", "__j", "__k")
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
#: Points of a cloud that one task takes whole; those of larger clouds are dealt by cells.
WHOLE = 1 << 17


def _offsets(half: bool = False):
    """The 27 cells around and with a cell, or the 13 of them that come after it, as an array of structs."""
    some = [d for d in product((-1, 0, 1), repeat=3) if not half or d > (0, 0, 0)]
    return F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"d{k}") for k, x in enumerate(d)]) for d in some])


def cell_normals(points: DataFrame, cell: float, cloud: str = "cloud_id") -> DataFrame:
    """(__cloud, __i, __j, __k, own, n, x, y, z, e1.., l1..): cells with points, own of them, and the plane of the n points around.

    Points are summed by cell first, about the cell's corner; what is dealt to the 27 cells around are those sums, not points.
    """
    at = [F.floor(F.col(c) / cell) for c in "xyz"]
    here = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz")).select(F.col(cloud).alias("__cloud"), *[a.alias(k) for a, k in zip(at, _CELL[1:])], *[(F.col(c) / cell - a).alias(f"r{k}") for k, (c, a) in enumerate(zip("xyz", at))])
    sums = here.groupBy(*_CELL).agg(F.count("*").alias("n"), *[F.sum(f"r{i}").alias(f"s{i}") for i in range(3)], *[F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"q{i}{j}") for i, j in _PAIRS])
    dealt = sums.withColumn("d", F.explode(_offsets()))
    d, s = [F.col(f"d.d{k}") for k in range(3)], [F.col(f"s{k}") for k in range(3)]
    moved = dealt.select(
        "__cloud", *[(F.col(k) - x).alias(k) for k, x in zip(_CELL[1:], d)], "n", F.when((d[0] == 0) & (d[1] == 0) & (d[2] == 0), F.col("n")).alias("own"),
        *[(s[i] + F.col("n") * d[i]).alias(f"s{i}") for i in range(3)], *[(F.col(f"q{i}{j}") + d[i] * s[j] + d[j] * s[i] + F.col("n") * d[i] * d[j]).alias(f"q{i}{j}") for i, j in _PAIRS],
    )
    around = moved.groupBy(*_CELL).agg(F.max("own").alias("own"), F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS]).where("own is not null")
    mean = [F.col(f"s{i}") / F.col("n") for i in range(3)]
    place = [((F.col(k) + m) * cell).alias(c) for k, m, c in zip(_CELL[1:], mean, "xyz")]
    spread = [((F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * cell * cell).alias(f"cov_{'xyz'[i]}{'xyz'[j]}") for i, j in _PAIRS]
    return principal_axes(around.select(*_CELL, "own", "n", *place, *spread))


def segment_cloud(points: DataFrame, cell: float, degrees: float = 15.0, flat: float = 0.15, least: int = 20, cloud: str = "cloud_id") -> DataFrame:
    """The rows of points (cloud_id, x, y, z, ...) with `part`, the first cell of their smooth part as text; our choice of laws.

    A cell is flat if the points in and around it stray at most `flat` cells (root of the mean square) from their plane, and fill
    more than a line. Flat neighbours whose normals are within `degrees`, and whose middles are within `flat` cells of each other's
    planes, belong together. Where the points in and around a cell are too few or too much in a line to tell a plane, as at a part's tip, the
    cell joins the nearest flat neighbour in whose plane they lie, by the same measure. Points in other cells, and in parts of fewer than `least`
    points, have a null part: edges, strays, noise. So have rows without a cloud or with null or non-numeric places; repeated rows count as often
    as they come. An empty table gives an empty one.

    A cloud of up to `WHOLE` points is one task's work, so its points are shuffled once and nothing else; larger ones are dealt by cells.
    """
    points = points.drop("part")
    large = durable(points.where(F.col(cloud).isNotNull()).groupBy(cloud).agg(F.count("*").alias("__n")).where(F.col("__n") > WHOLE).select(cloud), "large")
    some = bool(large.limit(1).count())
    rest = points.join(large, cloud, "left_anti").select(*points.columns) if some else points.where(F.col(cloud).isNotNull())
    schema = StructType([*points.schema.fields, StructField("__first", StringType())])

    def whole(table):
        import pyarrow as pa

        p = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in "xyz"], 1)
        first, cells = _within(p, cell, degrees, flat, least)
        names = pa.array([":".join(map(str, c)) for c in cells.tolist()], pa.string())
        return table.append_column("__first", names.take(pa.array(first, mask=first < 0)))

    out = rest.where(F.col(cloud).isNotNull()).groupBy(cloud).applyInArrow(whole, schema)
    out = out.withColumn("part", F.when(F.col("__first").isNotNull(), F.concat_ws(":", cloud, "__first"))).drop("__first")
    out = out.unionByName(points.where(F.col(cloud).isNull()).withColumn("part", F.lit(None).cast("string")))
    return out.unionByName(_dealt(points.join(large, cloud, "left_semi").select(*points.columns), cell, degrees, flat, least, cloud)) if some else out


def _within(p: np.ndarray, cell: float, degrees: float, flat: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For the points of one cloud: (row of the first cell of each point's part or -1, cells)."""
    fine = np.isfinite(p).all(1)
    out = np.full(len(p), -1)
    if not fine.any():
        return out, np.zeros((0, 3), np.int64)
    at = np.floor(p[fine] / cell)
    r = p[fine] / cell - at
    cells, of = np.unique(at.astype(np.int64), axis=0, return_inverse=True)
    of, m = of.ravel(), len(cells)
    sums = lambda x: np.bincount(of, x, m + 1)  # noqa: E731 - a last row of zeros stands for cells without points
    n, s = sums(np.ones(len(r))), np.stack([sums(r[:, i]) for i in range(3)], 1)
    q = np.zeros((m + 1, 3, 3))
    for i, j in _PAIRS:
        q[:, i, j] = q[:, j, i] = sums(r[:, i] * r[:, j])
    seen = [np.unique(cells[:, k]) for k in range(3)]

    def rows(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, there = np.zeros(len(c), np.int64), np.ones(len(c), bool)
        for k, u in enumerate(seen):
            i = np.minimum(np.searchsorted(u, c[:, k]), len(u) - 1)
            code, there = code * len(u) + i, there & (u[i] == c[:, k])
        return code, there

    own, _ = rows(cells)  # ascending, as cells are
    steps = np.array(list(product((-1, 0, 1), repeat=3)))
    code, there = rows((cells[None] + steps[:, None]).reshape(-1, 3))
    i = np.minimum(np.searchsorted(own, code), m - 1)
    near = np.where(there & (own[i] == code), i, m).reshape(27, m)
    d = steps[:, None].astype(float)
    around = n[near].sum(0)
    total = (s[near] + n[near][..., None] * d).sum(0)
    cross = d[..., :, None] * s[near][..., None, :]
    squares = (q[near] + cross + cross.swapaxes(2, 3) + n[near][..., None, None] * (d[..., :, None] * d[..., None, :])).sum(0)
    mean = total / around[:, None]
    cov = (squares / around[:, None, None] - mean[:, :, None] * mean[:, None]) * cell * cell
    values, axes = np.linalg.eigh(cov)
    middle, normal, off = (cells + mean) * cell, axes[:, :, 0], (flat * cell) ** 2
    even, wide = values[:, 0] <= off, values[:, 1] > (0.1 * cell) ** 2
    # the least cell by text that flat cells reach
    text = np.argsort(np.array([":".join(map(str, c)) for c in cells.tolist()]), kind="stable")
    label = np.empty(m, np.int64)
    label[text] = np.arange(m)
    a, b = np.broadcast_to(np.arange(m), (13, m)).ravel(), near[14:].ravel()
    a, b = a[b < m], b[b < m]
    both = (even & wide)[a] & (even & wide)[b]
    a, b = a[both], b[both]
    to = middle[b] - middle[a]
    close = np.abs((normal[a] * normal[b]).sum(1)) >= math.cos(math.radians(degrees))
    close &= ((to * normal[a]).sum(1) ** 2 <= off) & ((to * normal[b]).sum(1) ** 2 <= off)
    a, b = a[close], b[close]
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = np.minimum(label, label[text[label]])
        if (label == before).all():
            break
    label = np.where(even & wide, label, m)
    thin = np.flatnonzero(even & ~wide)
    j = near[:, thin]
    spread = np.concatenate([normal, np.zeros((1, 3))])[j]
    to = middle[thin] - np.concatenate([middle, np.zeros((1, 3))])[j]
    stray = (to * spread).sum(2) ** 2 + np.einsum("dti,tij,dtj->dt", spread, cov[thin], spread)
    joins = np.append(label < m, False)[j] & (stray <= off)
    far = np.where(joins, (to * to).sum(2), np.inf)
    rank = np.empty(m + 1, np.int64)
    rank[text], rank[m] = np.arange(m), m
    best = np.lexsort((rank[j], far), axis=0)[0] if len(thin) else np.zeros(0, int)
    label[thin] = np.where(joins[best, np.arange(len(thin))], label[j[best, np.arange(len(thin))] % m], m)
    size = np.bincount(label, n[:m], m + 1)
    size[m] = 0
    first = np.where(size[label] >= least, np.append(text, -1)[label], -1)
    out[fine] = first[of]
    return out, cells


def _dealt(points: DataFrame, cell: float, degrees: float, flat: float, least: int, cloud: str) -> DataFrame:
    """`segment_cloud` with every cloud dealt by cells, however many points it has."""
    normals = cell_normals(points.where(F.col(cloud).isNotNull()), cell, cloud)
    cov = [f"cov_{c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    cells = durable(normals.where(F.col("l3") <= (flat * cell) ** 2).select(*_CELL, "own", F.concat_ws(":", *_CELL).alias("node"), *[F.col(c).alias(f"p{c}") for c in "xyz"], *[F.col(f"e3{c}").alias(f"n{c}") for c in "xyz"], (F.col("l2") > (0.1 * cell) ** 2).alias("wide"), *cov), "cells")
    fit = cells.where("wide").drop("wide", *cov)
    next_to = fit.withColumn("d", F.explode(_offsets(half=True))).select("__cloud", *[(F.col(k) + F.col(f"d.d{i}")).alias(k) for i, k in enumerate(_CELL[1:])], F.col("node").alias("a"), *[F.col(f"{t}{c}").alias(f"a_{t}{c}") for t in "pn" for c in "xyz"])
    pair = next_to.join(fit, list(_CELL))
    dot = lambda f: sum((f(c) for c in "yz"), f("x"))
    off = [dot(lambda c, side=side: (F.col(f"p{c}") - F.col(f"a_p{c}")) * F.col(f"{side}n{c}")) for side in ("", "a_")]
    alike = F.abs(dot(lambda c: F.col(f"n{c}") * F.col(f"a_n{c}"))) >= math.cos(math.radians(degrees))
    links = pair.where(alike & (F.abs(off[0]) <= flat * cell) & (F.abs(off[1]) <= flat * cell)).select("a", F.col("node").alias("b"))
    grown = connected(links)
    flat_cells = fit.select(*_CELL, "own", "node").join(grown, "node", "left").withColumn("__part", F.coalesce("component", "node")).select(*_CELL, "own", "node", "__part")
    # cells that tell no plane
    own = [F.col(k).alias(f"own{k}") for k in _CELL[1:]]
    thin = cells.where("not wide").select("*", *own).withColumn("d", F.explode(_offsets())).select(F.col("__cloud"), *[(F.col(k) + F.col(f"d.d{i}")).alias(k) for i, k in enumerate(_CELL[1:])], *[f"own{k}" for k in _CELL[1:]], F.col("own").alias("t_own"), F.col("node").alias("thin"), *[F.col(f"p{c}").alias(f"a_p{c}") for c in "xyz"], *cov)
    at = thin.join(fit.select(*_CELL, "node", *[f"{t}{c}" for t in "pn" for c in "xyz"]), list(_CELL))
    spread = sum((F.col(f"cov_{'xyz'[i]}{'xyz'[j]}") * F.col(f"n{'xyz'[i]}") * F.col(f"n{'xyz'[j]}") * (1.0 if i == j else 2.0) for i, j in _PAIRS), F.lit(0.0))
    lie = at.where(off[0] * off[0] + spread <= (flat * cell) ** 2)
    far = dot(lambda c: (F.col(f"p{c}") - F.col(f"a_p{c}")) * (F.col(f"p{c}") - F.col(f"a_p{c}")))
    joined = lie.groupBy("__cloud", *[f"own{k}" for k in _CELL[1:]], "t_own", "thin").agg(F.min(F.struct(far.alias("far"), "node")).alias("m"))
    thin_cells = joined.select("__cloud", *[F.col(f"own{k}").alias(k) for k in _CELL[1:]], F.col("t_own").alias("own"), F.col("m.node").alias("node")).join(flat_cells.select("node", "__part"), "node")
    of_cell = flat_cells.unionByName(thin_cells.select(*_CELL, "own", "node", "__part"))
    large = of_cell.groupBy("__part").agg(F.sum("own").alias("size")).where(F.col("size") >= least)
    parts = durable(of_cell.join(large, "__part").select(*_CELL, "__part"), "parts")
    discard(cells)
    discard(grown)
    keyed = points.select("*", F.col(cloud).alias("__cloud"), *[F.floor(F.col(c) / cell).alias(k) for c, k in zip("xyz", _CELL[1:])])
    return keyed.join(parts, list(_CELL), "left").withColumn("part", F.col("__part")).drop(*_CELL, "__part")
