"""Spheres, cones and boxes found in clouds with outliers.

Hypotheses come from minimal sets out of `SAMPLE` of a cloud's points; all points judge them, and all inliers refine the best ones by Gauss-Newton steps
until these vanish. A cloud of up to `PART` points is one task's work: more hypotheses are drawn until two of them have led to the best support. The points of a
larger one are dealt into parts of about `PART`, a row each, so a cloud may have any number of them, and normal equations are summed over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, durable
from .adjustment import _vector, rotation_of

PART, SAMPLE, NEIGHBOURS = 4_096, 384, 10
#: How often hypotheses are drawn at most, how many of a kind are refined, and the least step, of the parameters' size.
BATCHES, REFINED, SETTLED = 16, 3, 1e-10


def _normals(p: np.ndarray) -> np.ndarray:
    """Unit normals of sampled points by the least principal axis of their neighbours."""
    q = p - p.mean(0)
    square = (q * q).sum(1)
    d = square[:, None] + square - 2 * np.einsum("ik,jk->ij", q, q)  # not @, whose threads would only wait for each other
    near = p[np.argpartition(d, NEIGHBOURS - 1, 1)[:, :NEIGHBOURS] if len(p) > NEIGHBOURS else np.argsort(d, 1)]
    near = near - near.mean(1, keepdims=True)
    return np.linalg.eigh(np.einsum("nki,nkj->nij", near, near))[1][:, :, 0]


def _sets(rng, n: int, size: int, sets: int) -> np.ndarray:
    return rng.integers(0, n, (sets, size))


class Sphere:
    """Centre and radius."""

    least, width = 4, 4

    @staticmethod
    def propose(p: np.ndarray, normals: np.ndarray, rng, sets: int, tolerance: float) -> np.ndarray:
        q = p[_sets(rng, len(p), 4, sets)]
        a, b = 2 * (q[:, 1:] - q[:, :1]), (q[:, 1:] ** 2).sum(2) - (q[:, :1] ** 2).sum(2)
        fine = np.abs(np.linalg.det(a)) > 1e-9 * np.abs(a).max((1, 2)) ** 3
        c = np.linalg.solve(a[fine], b[fine][..., None])[..., 0]
        return np.concatenate([c, np.linalg.norm(q[fine, 0] - c, axis=1)[:, None]], 1)

    @staticmethod
    def distance(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.linalg.norm(p - h[:, None, :3], axis=2) - h[:, 3:4]

    @staticmethod
    def slopes(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        v = p - h[:3]
        return np.column_stack([-v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), np.full(len(p), -1.0)])

    @staticmethod
    def tidy(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h[:3], np.abs(h[3:])])

    @staticmethod
    def sizes(h: np.ndarray) -> tuple[float, float, float]:
        return h[3], h[3], h[3]


class Cone:
    """Apex, unit axis into the cone, half angle."""

    least, width = NEIGHBOURS, 7

    @staticmethod
    def propose(p: np.ndarray, normals: np.ndarray, rng, sets: int, tolerance: float) -> np.ndarray:
        i = _sets(rng, len(p), 3, sets)
        n = normals[i]
        fine = np.abs(np.linalg.det(n)) > 1e-3
        i, n = i[fine], n[fine]
        apex = np.linalg.solve(n, (n * p[i]).sum(2)[..., None])[..., 0]
        to = p[i] - apex[:, None]
        to /= np.maximum(np.linalg.norm(to, axis=2, keepdims=True), 1e-12)
        axis = np.cross(to[:, 1] - to[:, 0], to[:, 2] - to[:, 0])
        axis /= np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-12)
        axis *= np.where((to.mean(1) * axis).sum(1) < 0, -1.0, 1.0)[:, None]
        angle = np.arccos(np.clip((to * axis[:, None]).sum(2), -1, 1)).mean(1)
        return np.concatenate([apex, axis, angle[:, None]], 1)

    @staticmethod
    def distance(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        v, axis = p - h[:, None, :3], h[:, 3:6] / np.maximum(np.linalg.norm(h[:, 3:6], axis=1, keepdims=True), 1e-12)
        along = np.einsum("hni,hi->hn", v, axis)
        out = np.linalg.norm(v - along[..., None] * axis[:, None], axis=2)
        return out * np.cos(h[:, 6:7]) - along * np.sin(h[:, 6:7])

    @staticmethod
    def slopes(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        size = max(np.linalg.norm(h[3:6]), 1e-12)
        v, axis, c, s = p - h[:3], h[3:6] / size, np.cos(h[6]), np.sin(h[6])
        along = v @ axis
        across = v - along[:, None] * axis
        out = np.linalg.norm(across, axis=1)
        e = across / np.maximum(out, 1e-12)[:, None]
        return np.column_stack([s * axis - c * e, -(along * c + out * s)[:, None] * e / size, -out * s - along * c])

    @staticmethod
    def tidy(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h[:3], h[3:6] / max(np.linalg.norm(h[3:6]), 1e-12), h[6:]])

    @staticmethod
    def sizes(h: np.ndarray) -> tuple[float, float, float]:
        return np.degrees(h[6]), np.degrees(h[6]), np.degrees(h[6])


class Box:
    """Centre, rotation vector, half sizes along the box's own axes."""

    least, width = NEIGHBOURS, 9

    @staticmethod
    def propose(p: np.ndarray, normals: np.ndarray, rng, sets: int, tolerance: float) -> np.ndarray:
        i, j = _sets(rng, len(p), 2, 2 * sets).T
        a, b = normals[i], normals[j]
        b = b - a * (a * b).sum(1, keepdims=True)
        square = np.flatnonzero(np.linalg.norm(b, axis=1) >= 0.9)[: sets // 2]  # to each other
        a, b = a[square], b[square] / np.linalg.norm(b[square], axis=1, keepdims=True)
        r = np.stack([a, b, np.cross(a, b)], 2)
        axes = r.transpose(0, 2, 1).reshape(-1, 3)
        # the outer faces: planes on which many points with that normal lie
        on = np.abs(np.einsum("ak,nk->an", axes, normals)) > 0.95
        x = np.sort(np.where(on, np.einsum("ak,nk->an", axes, p), np.inf), 1)
        row, k = np.nonzero(np.isfinite(x))
        low, high = (x[row, k].min(), x[row, k].max()) if len(row) else (0.0, 0.0)
        y = x[row, k] - low + row * (high - low + 8 * tolerance)
        n = np.zeros(x.shape, int)
        n[row, k] = np.searchsorted(y, y + 2 * tolerance, "right") - np.searchsorted(y, y - 2 * tolerance)
        face = (n >= 0.25 * n.max(1, keepdims=True, initial=0)) & (n > 0)
        at, first, last = np.arange(len(x)), face.argmax(1), x.shape[1] - 1 - face[:, ::-1].argmax(1)
        ends = np.stack([np.where(face.any(1), np.where(np.isfinite(x[at, e]), x[at, e], 0.0), 0.0).reshape(-1, 3) for e in (first, last)])
        return np.concatenate([np.einsum("hij,hj->hi", r, ends.sum(0) / 2), _vector(r), (ends[1] - ends[0]) / 2], 1)

    @staticmethod
    def distance(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = np.abs(np.einsum("hji,hnj->hni", rotation_of(h[:, 3:6]), p - h[:, None, :3])) - np.abs(h[:, None, 6:])
        return np.linalg.norm(np.maximum(q, 0), axis=2) + np.minimum(q.max(2), 0)

    @staticmethod
    def slopes(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        r = rotation_of(h[None, 3:6])[0]
        q = (p - h[:3]) @ r
        s = np.abs(q) - np.abs(h[6:])
        out, top = np.maximum(s, 0), s.max(1, keepdims=True)
        far = np.linalg.norm(out, axis=1, keepdims=True)
        g = np.where(top > 0, out / np.maximum(far, 1e-300), s == top)
        step = 1e-6 * np.maximum(1.0, np.abs(h[3:6]))
        turned = Box.distance(np.tile(h, (6, 1)) + np.pad(np.concatenate([np.diag(step), -np.diag(step)]), ((0, 0), (3, 3))), p)
        return np.column_stack([-(g * np.sign(q)) @ r.T, ((turned[:3] - turned[3:]) / (2 * step[:, None])).T, -g * np.sign(h[6:])])

    @staticmethod
    def tidy(h: np.ndarray) -> np.ndarray:
        return np.concatenate([h[:6], np.abs(h[6:])])

    @staticmethod
    def sizes(h: np.ndarray) -> tuple[float, float, float]:
        a, b, c = sorted(2 * h[6:], reverse=True)
        return a, b, c


KINDS = {"sphere": Sphere, "cone": Cone, "box": Box}


def _cloud(part) -> np.ndarray:
    return np.stack([np.asarray(part.x, float), np.asarray(part.y, float), np.asarray(part.z, float)], 1)


def _support(solid, h: np.ndarray, p: np.ndarray, tolerance: float) -> np.ndarray:
    return np.concatenate([(np.abs(solid.distance(h[a : a + 16], p)) <= tolerance).sum(1) for a in range(0, len(h), 16)])


def _step(solid, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """A hypothesis after a step by normal equations, and how large the step was."""
    step = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    return solid.tidy(h - step), float(np.abs(step).max() / max(1.0, np.abs(h).max()))


def _refined(solid, h: np.ndarray, p: np.ndarray, tolerance: float, rounds: int) -> tuple[int, float, np.ndarray]:
    """(inliers, minus the sum of their squares, hypothesis) of the best of the steps from a hypothesis."""
    best, size, since = (-1, 0.0, h), np.inf, 0
    for k in range(4 * rounds + 1):
        e = solid.distance(h[None], p)[0]
        near = np.abs(e) <= tolerance
        n = int(near.sum())
        now = (n, -float((e[near] ** 2).sum()), h)
        since = 0 if now[:2] > best[:2] else since + 1
        best = best if since else now
        if not n or k == 4 * rounds or size <= SETTLED or since == rounds:
            break
        j = solid.slopes(h, p[near])
        h, size = _step(solid, h, np.einsum("ni,nj->ij", j, j), np.einsum("ni,n->i", j, e[near]))
        if not np.isfinite(h).all():
            break
    return best


def _fitted(p: np.ndarray, tolerance: float, kinds: tuple[str, ...], hypotheses: int, rounds: int) -> tuple[int, float, str, np.ndarray] | None:
    """(inliers, sum of their squares, kind, hypothesis) of a whole cloud, whatever the order of its points."""
    if not len(p):
        return None
    p = p[np.lexsort(p.T)]
    drawn = p[np.random.default_rng(0).permutation(len(p))[:SAMPLE]]
    normals, rng, best, reached = _normals(drawn), np.random.default_rng(0), None, []
    for _ in range(BATCHES):
        led = {}
        for k, kind in enumerate(kinds):
            solid = KINDS[kind]
            h = solid.propose(drawn, normals, rng, hypotheses, tolerance) if len(p) >= solid.least else np.zeros((0, solid.width))
            h = h[np.isfinite(h).all(1)]
            if len(h):
                led[k] = h[np.argsort(-_support(solid, h, p, tolerance), kind="stable")[:REFINED]]
        for rank in range(REFINED):
            for k in led if rank == 0 else [best[1]] if best and best[1] in led else []:
                if rank < len(led[k]):
                    n, off, h = _refined(KINDS[kinds[k]], led[k][rank], p, tolerance, rounds)
                    reached.append(n)
                    if best is None or (n, -k, off) > (best[0], -best[1], best[2]):
                        best = n, k, off, h
            if best and reached.count(best[0]) > 1:
                break
        if not led or reached.count(best[0]) > 1:
            break
    return best and (best[0], -best[2], kinds[best[1]], best[3])


def _whole(tolerance: float, kinds: tuple[str, ...], hypotheses: int, rounds: int):
    def run(table):
        import pyarrow as pa

        p = np.stack([table.column(c).to_numpy() for c in "xyz"], 1)
        p = p[~np.isnan(p).any(1)]
        found = _fitted(p, tolerance, kinds, hypotheses, rounds)
        n, off, kind, h = found or (0, 0.0, "", np.zeros(0))
        out = {"kind": [kind], "h": pa.array([h.tolist()], pa.list_(pa.float64())), "inliers": [n], "squares": [off], "n": [len(p)]}
        return pa.table({"cloud_id": table.column("cloud_id")[:1]} | out).slice(0, 1 if found else 0)

    return run


def _proposed(kinds: tuple[str, ...], sets: int, tolerance: float):
    """The hypotheses of each kind that most drawn points lie on, of four times as many."""

    def run(key: tuple, frame):
        import pandas as pd

        p = frame.sort_values(["slot"])[["x", "y", "z"]].to_numpy(float)
        rows, normals, rng = [], _normals(p), np.random.default_rng(0)
        for kind in kinds:
            solid = KINDS[kind]
            if len(p) >= solid.least:
                h = np.concatenate([solid.propose(p, normals, rng, sets, tolerance) for _ in range(4)])
                h = h[np.isfinite(h).all(1)]
                if len(h):
                    h = h[np.argsort(-_support(solid, h, p, tolerance), kind="stable")[:sets]]
                    rows.append((key[0], kind, h.ravel().tolist()))
        return pd.DataFrame(rows, columns=["cloud_id", "kind", "h"])

    return run


def _judged(tolerance: float):
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for part in frame.itertuples():
                solid = KINDS[part.kind]
                n = _support(solid, np.asarray(part.h, float).reshape(-1, solid.width), _cloud(part), tolerance)
                rows += [(part.cloud_id, part.kind, i, int(c)) for i, c in enumerate(n)]
            yield pd.DataFrame(rows, columns=["cloud_id", "kind", "i", "inliers"])

    return run


_SUMS = [*[f"a{i}{j}" for i in range(9) for j in range(i, 9)], *[f"b{i}" for i in range(9)]]
_CELLS = np.triu_indices(9)


def _summed(tolerance: float):
    """Normal equations of the inliers of each part; unused parameters stay zero."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for part in frame.itertuples():
                p, solid = _cloud(part), KINDS[part.kind]
                h = np.asarray(part.h, float)
                e = solid.distance(h[None], p)[0]
                near = np.abs(e) <= tolerance
                e, p, w = e[near], p[near], solid.width
                j = np.zeros((len(p), 9))
                j[:, :w] = solid.slopes(h, p)
                rows.append((part.cloud_id, part.kind, part.i, *(j.T @ j)[_CELLS], *(j.T @ e), int(near.sum()), float((e * e).sum())))
            yield pd.DataFrame(rows, columns=["cloud_id", "kind", "i", *_SUMS, "inliers", "squares"])

    return run


def _stepped(frames: Iterator) -> Iterator:
    for frame in frames:
        out = []
        for row, sums in zip(frame.itertuples(), frame[_SUMS].to_numpy(float)):
            solid, h = KINDS[row.kind], np.asarray(row.h, float)
            a, w = np.zeros((9, 9)), solid.width
            a[_CELLS] = a.T[_CELLS] = sums[: len(_CELLS[0])]
            out.append((_step(solid, h, a[:w, :w], sums[len(_CELLS[0]) :][:w])[0] if row.inliers else h).tolist())
        yield frame.assign(h=out)[["cloud_id", "kind", "i", "h"]]


def _told(frames: Iterator) -> Iterator:
    import pandas as pd

    for frame in frames:
        rows = []
        for r in frame.itertuples():
            h = np.asarray(r.h, float)
            sizes = KINDS[r.kind].sizes(h)
            residual = float(np.sqrt(r.squares / r.inliers)) if r.inliers else float("nan")
            rows.append((r.cloud_id, r.kind, *h[:3].tolist(), h[3:].tolist(), *map(float, sizes), r.n, r.inliers, residual, float(np.exp(-residual / r.tolerance) * r.inliers / r.n) if r.inliers else 0.0))
        yield pd.DataFrame(rows, columns=["cloud_id", "kind", "cx", "cy", "cz", "shape", "size1", "size2", "size3", "n", "inliers", "residual", "confidence"])


def fit_solids(points: DataFrame, tolerance: float, kinds: tuple[str, ...] = ("sphere", "cone", "box"), hypotheses: int = 64, rounds: int = 6) -> DataFrame:
    """(cloud_id, kind, cx, cy, cz, shape, size1, size2, size3, n, inliers, residual, confidence): the solid of each cloud (cloud_id, x, y, z) that most of its points lie on.

    cx, cy, cz is the centre of a sphere or box, or a cone's apex; `shape` has the other parameters of its kind. Sizes are a radius, a half angle in degrees, or three side lengths,
    longest first. Points within `tolerance` of the surface are inliers; of equally supported kinds the first given wins. Residual is the inliers' root mean square distance, confidence their
    share times exp(-residual / tolerance), our choice. Rows with nulls are left out, repeated points count each, and clouds that give no hypothesis (under 4 or 10 points, or all in one place) have no row.
    """
    id_kind = points.schema["cloud_id"].dataType.simpleString()
    rows = points.select("cloud_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where("cloud_id is not null")  # places are looked at in the tasks: a filter would compute them once more
    large = durable(rows.groupBy("cloud_id").agg(F.count("*").alias("rows")).where(F.col("rows") > PART).select("cloud_id"), "large")
    some = bool(large.limit(1).count())
    rest = rows.join(large, "cloud_id", "left_anti") if some else rows
    found = rest.groupBy("cloud_id").applyInArrow(_whole(tolerance, tuple(kinds), hypotheses, rounds), f"cloud_id {id_kind}, kind string, h array<double>, inliers long, squares double, n long")
    if some:
        rows = rows.join(large, "cloud_id", "left_semi").dropna()
        sizes = rows.groupBy("cloud_id").agg(F.count("*").alias("n"))
        found = found.unionByName(_dealt(rows.join(sizes, "cloud_id"), id_kind, tolerance, tuple(kinds), hypotheses, rounds).join(sizes, "cloud_id"))
    return found.withColumn("tolerance", F.lit(float(tolerance))).mapInPandas(_told, f"cloud_id {id_kind}, kind string, cx double, cy double, cz double, shape array<double>, size1 double, size2 double, size3 double, n long, inliers long, residual double, confidence double")


def _dealt(rows: DataFrame, id_kind: str, tolerance: float, kinds: tuple[str, ...], hypotheses: int, rounds: int) -> DataFrame:
    """(cloud_id, kind, h, inliers, squares) of clouds (cloud_id, x, y, z, n) whose points are dealt into parts; `REFINED` hypotheses of a kind take 2 * rounds steps."""
    rows = rows.withColumn("hash", F.xxhash64("x", "y", "z"))
    dealt = rows.withColumn("part", F.abs(F.xxhash64("hash", F.lit("part")) % F.ceil(F.col("n") / PART)))
    parts = durable(dealt.groupBy("cloud_id", "part").agg(F.collect_list(F.struct("x", "y", "z")).alias("p")).select("cloud_id", *[F.col(f"p.{c}").alias(c) for c in "xyz"]), "clouds")
    drawn = rows.groupBy("cloud_id", F.pmod("hash", F.lit(SAMPLE)).alias("slot")).agg(F.min(F.struct("hash", "x", "y", "z")).alias("m")).select("cloud_id", "slot", "m.x", "m.y", "m.z")
    guesses = durable(drawn.groupBy("cloud_id").applyInPandas(_proposed(kinds, hypotheses, tolerance), f"cloud_id {id_kind}, kind string, h array<double>"), "guesses")
    votes = parts.join(guesses, "cloud_id").mapInPandas(_judged(tolerance), f"cloud_id {id_kind}, kind string, i int, inliers long").groupBy("cloud_id", "kind", "i").agg(F.sum("inliers").alias("inliers"))
    best = votes.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id", "kind").orderBy(F.desc("inliers"), "i"))).where(F.col("rank") <= REFINED).select("cloud_id", "kind", "i")
    width = F.element_at(F.create_map(*[F.lit(x) for k, s in KINDS.items() for x in (k, s.width)]), F.col("kind"))
    fit = durable(guesses.join(best, ["cloud_id", "kind"]).select("cloud_id", "kind", "i", F.slice("h", F.col("i") * width + 1, width).alias("h")), "solids")
    columns = f"cloud_id {id_kind}, kind string, i int, " + ", ".join(f"{c} double" for c in _SUMS) + ", inliers long, squares double"

    def sums(fit: DataFrame) -> DataFrame:
        return parts.join(fit, "cloud_id").mapInPandas(_summed(tolerance), columns).groupBy("cloud_id", "kind", "i").agg(*[F.sum(c).alias(c) for c in (*_SUMS, "inliers", "squares")])

    for _ in range(2 * rounds):
        before, fit = fit, durable(sums(fit).join(fit, ["cloud_id", "kind", "i"]).mapInPandas(_stepped, f"cloud_id {id_kind}, kind string, i int, h array<double>"), "solids")
        discard(before)
    order = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(kinds) for x in (name, -k)]), F.col("kind"))
    final = sums(fit).join(fit, ["cloud_id", "kind", "i"]).groupBy("cloud_id").agg(F.max(F.struct("inliers", order.alias("order"), (-F.col("squares")).alias("off"), "kind", "h")).alias("b"))
    return final.select("cloud_id", "b.kind", "b.h", "b.inliers", (-F.col("b.off")).alias("squares"))
