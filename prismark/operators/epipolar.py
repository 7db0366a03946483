"""Relative poses of pairs of views, and poses of views of known points, without any pose to begin with.

Matches of a pair are dealt into parts of about `PART`, a row each, so a pair may have any number of them. Hypotheses come from minimal sets
drawn out of a bounded number of a pair's matches, chosen by hash; they are judged, refined and voted on with all matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Matches of a part, about.
PART = 4_096
#: How often hypotheses are drawn at most, the chance to miss at which drawing ends, and how many of each draw are fitted to their inliers.
BATCHES, MISS, FITTED = 64, 1e-9, 4
_SQUARE = [f"a{i}{j}" for i in range(9) for j in range(i, 9)]
_UPPER = np.triu_indices(9)


def essential_of(square: np.ndarray) -> np.ndarray:
    """Essential matrices (n, 3, 3) out of sums (n, 9, 9) of a a': the least eigenvector, with singular values 1, 1, 0."""
    e = np.linalg.eigh(square)[1][:, :, 0].reshape(-1, 3, 3)
    u, _, w = np.linalg.svd(e)
    return np.einsum("nij,j,njk->nik", u, np.array([1.0, 1.0, 0.0]), w)


def _terms(x1, y1, x2, y2) -> np.ndarray:
    one = np.ones(len(x1))
    return np.stack([x2 * x1, x2 * y1, x2, y2 * x1, y2 * y1, y2, x1, y1, one], 1)


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (hypotheses, matches) of places a, b (n, 3) from essential matrices (h, 3, 3), in the places' units, to first order."""
    l2, l1 = np.einsum("hij,nj->hni", e, a), np.einsum("hji,nj->hni", e, b)
    off = np.abs(np.einsum("hni,ni->hn", l2, b))
    return off / np.sqrt(np.maximum((l2[..., :2] ** 2).sum(-1) + (l1[..., :2] ** 2).sum(-1), 1e-300))


def decomposed(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four (rotation, unit shift) of an essential matrix, with x2 ~ R x1 + t."""
    u, _, w = np.linalg.svd(e)
    u, w = u * np.sign(np.linalg.det(u)), w * np.sign(np.linalg.det(w))
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    r = np.stack([u @ turn @ w, u @ turn @ w, u @ turn.T @ w, u @ turn.T @ w])
    return r, np.stack([u[:, 2], -u[:, 2], u[:, 2], -u[:, 2]])


def _places(part) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(len(part.x1))
    return np.stack([part.x1, part.y1, one], 1), np.stack([part.x2, part.y2, one], 1)


def _drawn(hypotheses: int, most: float):
    """The best hypotheses by a pair's drawn matches, of as many sets as make a set without wrong matches all but sure."""

    def run(key: tuple, frame):
        import pandas as pd

        f = frame.sort_values(["h", "x1", "y1", "x2", "y2"])
        if len(f) < 8:
            return pd.DataFrame({"pair_id": [], "e": []})
        rng = np.random.default_rng(0)  # which matches are drawn is told by their hashes
        x1, y1, x2, y2 = (f[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        terms, one = _terms(x1, y1, x2, y2), np.ones(len(f))
        a, b = np.stack([x1, y1, one], 1), np.stack([x2, y2, one], 1)
        best, votes = np.zeros((0, 3, 3)), np.zeros(0, int)
        for k in range(BATCHES):
            rows = np.argsort(rng.random((hypotheses, len(f))), axis=1)[:, :8]
            s = terms[rows]
            e = essential_of(np.einsum("hki,hkj->hij", s, s))
            near = sampson(e, a, b) <= most
            lead = np.argsort(-near.sum(1), kind="stable")[:FITTED]
            for _ in range(3):  # the first ones fitted to their inliers
                w = near[lead].astype(float)
                fit = essential_of(np.einsum("hn,ni,nj->hij", w, terms, terms, optimize=True))
                now = sampson(fit, a, b) <= most
                better = now.sum(1) >= np.maximum(near[lead].sum(1), 8)
                e[lead[better]], near[lead[better]] = fit[better], now[better]
            best, votes = np.concatenate([best, e]), np.concatenate([votes, near.sum(1)])
            order = np.argsort(-votes, kind="stable")[:hypotheses]
            best, votes = best[order], votes[order]
            if (k + 1) * hypotheses * np.log1p(-min((votes[0] / len(f)) ** 8, 1 - 1e-9)) <= np.log(MISS):
                break
        return pd.DataFrame({"pair_id": [key[0]], "e": [best.ravel().tolist()]})

    return run


def _votes(most: float):
    """Inliers of each hypothesis in each part."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for part in frame.itertuples():
                a, b = _places(part)
                n = (sampson(np.asarray(part.e).reshape(-1, 3, 3), a, b) <= most).sum(1)
                yield pd.DataFrame({"pair_id": part.pair_id, "h": np.arange(len(n)), "inliers": n})

    return run


def _squares(most: float):
    """Sums of a a' over the inliers of each part."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for part in frame.itertuples():
                a, b = _places(part)
                near = sampson(np.asarray(part.e).reshape(1, 3, 3), a, b)[0] <= most
                t = _terms(a[near, 0], a[near, 1], b[near, 0], b[near, 1])
                yield pd.DataFrame((t.T @ t)[_UPPER][None], columns=_SQUARE).assign(pair_id=part.pair_id)[["pair_id", *_SQUARE]]

    return run


def _refined(frames: Iterator) -> Iterator:
    import pandas as pd

    for frame in frames:
        if len(frame):
            m = np.zeros((len(frame), 9, 9))
            m[:, _UPPER[0], _UPPER[1]] = m[:, _UPPER[1], _UPPER[0]] = frame[_SQUARE].to_numpy(float)
            yield pd.DataFrame({"pair_id": frame["pair_id"], "e": list(essential_of(m).reshape(-1, 9))})


def _ahead(most: float):
    """How many inliers of each part lie in front of both cameras, for each of the four poses."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for part in frame.itertuples():
                a, b = _places(part)
                e = np.asarray(part.e).reshape(3, 3)
                near = sampson(e[None], a, b)[0] <= most
                a, b = a[near], b[near]
                rows = []
                for r, t in zip(*decomposed(e)):
                    c = a @ r.T  # depths d1 and d2 of d2 b = d1 c + t, by least squares
                    cc, cb, bb, ct, bt = (c * c).sum(1), (c * b).sum(1), (b * b).sum(1), c @ t, b @ t
                    det = np.maximum(cc * bb - cb * cb, 1e-300)
                    d1, d2 = (cb * bt - bb * ct) / det, (cc * bt - cb * ct) / det
                    rows.append(int(((d1 > 0) & (d2 > 0)).sum()))
                yield pd.DataFrame({"pair_id": part.pair_id, "pose": np.arange(4), "votes": rows, "inliers": int(near.sum())})

    return run


def _chosen(frames: Iterator) -> Iterator:
    for frame in frames:
        poses = [decomposed(np.asarray(e).reshape(3, 3)) for e in frame["e"]]
        r = [p[0][k].ravel().tolist() for p, k in zip(poses, frame["pose"])]
        t = [p[1][k].tolist() for p, k in zip(poses, frame["pose"])]
        yield frame.assign(rotation=r, shift=t)[["pair_id", "n", "inliers", "votes", "essential", "rotation", "shift"]]


def relative_poses(matches: DataFrame, k: tuple[float, float, float, float], most_pixels: float = 1.0, hypotheses: int = 64, sample: int = 256, refinements: int = 2) -> DataFrame:
    """(pair_id, n, inliers, votes, essential, rotation, shift) of matches (pair_id, u1, v1, u2, v2), with x2 ~ R x1 + t for camera coordinates and a unit shift.

    Of each pair sets of eight matches, drawn from up to `sample` matches (the least hash of each of so many slots), give an essential matrix each; `hypotheses` of them are drawn at a time, until
    by the best one's share of inliers a set without a wrong match was all but surely among them, and so many are kept. The one with most inliers of all the pair's matches (Sampson distance up
    to `most_pixels`), the first of equal ones, is fitted anew to its inliers; of the fits the one with most inliers holds, the last of equal ones. The pose of the four for which most inliers lie before both cameras is
    returned. Pairs with less than eight matches are left out, as are matches with nulls; repeated matches count each. Matches of points in one plane, or without a shift, do not tell a pose.
    """
    fx, fy, cx, cy = k
    xy = lambda u, v, i: [((F.col(u) - cx) / fx).alias(f"x{i}"), ((F.col(v) - cy) / fy).alias(f"y{i}")]
    rows = matches.select("pair_id", "u1", "v1", "u2", "v2").dropna().select("pair_id", *xy("u1", "v1", 1), *xy("u2", "v2", 2))
    rows = rows.withColumn("h", F.xxhash64("x1", "y1", "x2", "y2"))
    sizes = rows.groupBy("pair_id").agg(F.count("*").alias("n"))
    dealt = rows.join(sizes, "pair_id").withColumn("part", F.abs(F.col("h") % F.ceil(F.col("n") / PART)))
    packed = durable(dealt.groupBy("pair_id", "part").agg(F.first("n").alias("n"), *[F.collect_list(F.struct("h", "x1", "y1", "x2", "y2")).alias("m")]).select("pair_id", "part", "n", F.slice(F.sort_array("m"), 1, 4 * sample).alias("least"), *[F.col(f"m.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]), "matches")
    few = packed.where("n >= 8").select("pair_id", F.explode("least").alias("m"))
    ranked = few.groupBy("pair_id", F.pmod("m.h", F.lit(sample)).alias("slot")).agg(F.min("m").alias("m"))
    kind = matches.schema["pair_id"].dataType.simpleString()
    most = most_pixels / max(fx, fy)
    guesses = durable(ranked.select("pair_id", "m.*").groupBy("pair_id").applyInPandas(_drawn(hypotheses, most), f"pair_id {kind}, e array<double>"), "guesses")
    parts = packed.select("pair_id", "x1", "y1", "x2", "y2")
    counted = parts.join(guesses, "pair_id").mapInPandas(_votes(most), f"pair_id {kind}, h int, inliers long").groupBy("pair_id", "h").agg(F.sum("inliers").alias("inliers"))
    best = counted.groupBy("pair_id").agg(F.max(F.struct("inliers", (-F.col("h")).alias("h"))).alias("b")).select("pair_id", (-F.col("b.h")).alias("h"))
    fit = durable(guesses.join(best, "pair_id").select("pair_id", F.slice("e", F.col("h") * 9 + 1, 9).alias("e")), "essential")
    fits = fit.withColumn("k", F.lit(0))
    for k in range(refinements):
        sums = parts.join(fit, "pair_id").mapInPandas(_squares(most), f"pair_id {kind}, " + ", ".join(f"{c} double" for c in _SQUARE)).groupBy("pair_id").agg(*[F.sum(c).alias(c) for c in _SQUARE])
        fit = durable(sums.mapInPandas(_refined, f"pair_id {kind}, e array<double>"), "essential")
        fits = fits.unionByName(fit.withColumn("k", F.lit(k + 1)))
    all_fits = fits.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("f")).select("pair_id", F.flatten("f.e").alias("e"))
    counted = parts.join(all_fits, "pair_id").mapInPandas(_votes(most), f"pair_id {kind}, h int, inliers long").groupBy("pair_id", "h").agg(F.sum("inliers").alias("inliers"))
    best = counted.groupBy("pair_id").agg(F.max(F.struct("inliers", "h")).alias("b")).select("pair_id", F.col("b.h").alias("h"))
    fit = durable(all_fits.join(best, "pair_id").select("pair_id", F.slice("e", F.col("h") * 9 + 1, 9).alias("e")), "essential")
    votes = parts.join(fit, "pair_id").mapInPandas(_ahead(most), f"pair_id {kind}, pose int, votes long, inliers long").groupBy("pair_id", "pose").agg(F.sum("votes").alias("votes"), F.sum("inliers").alias("inliers"))
    won = votes.groupBy("pair_id").agg(F.max(F.struct("votes", (-F.col("pose")).alias("p"), "inliers")).alias("w")).select("pair_id", "w.votes", "w.inliers", (-F.col("w.p")).alias("pose"))
    out = won.join(fit, "pair_id").join(sizes, "pair_id").withColumn("essential", F.col("e"))
    return out.mapInPandas(_chosen, f"pair_id {kind}, n long, inliers long, votes long, essential array<double>, rotation array<double>, shift array<double>")


_AXES = ("x", "y", "z", "o")


def _resected(frames: Iterator) -> Iterator:
    import pandas as pd

    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    for frame in frames:
        if not len(frame):
            continue
        s = np.zeros((len(frame), 4, 4, 4))
        for q, name in enumerate(("one", "a", "b", "ab")):
            for i, j in pairs:
                s[:, q, i, j] = s[:, q, j, i] = frame[f"{name}_{_AXES[i]}{_AXES[j]}"].to_numpy(float)
        m = np.zeros((len(frame), 12, 12))
        m[:, :4, :4] = m[:, 4:8, 4:8] = s[:, 0]
        m[:, :4, 8:] = m[:, 8:, :4] = -s[:, 1]
        m[:, 4:8, 8:] = m[:, 8:, 4:8] = -s[:, 2]
        m[:, 8:, 8:] = s[:, 3]
        values, vectors = np.linalg.eigh(m)
        p = vectors[:, :, 0].reshape(-1, 3, 4)
        u, d, w = np.linalg.svd(p[:, :, :3])
        sign = np.sign(np.linalg.det(u @ w))
        r = (u @ w) * sign[:, None, None]
        t = p[:, :, 3] * sign[:, None] / d.mean(1)[:, None]
        spread, mean = frame["spread"].to_numpy(float), frame[["mx", "my", "mz"]].to_numpy(float)
        origin = mean - spread[:, None] * np.einsum("nji,nj->ni", r, t)
        clear = (frame["n"].to_numpy() >= 6) & (values[:, 1] > 1e-9 * values[:, -1])
        yield pd.DataFrame({"view_id": frame["view_id"], "n": frame["n"], "origin": [o.tolist() if ok else None for o, ok in zip(origin, clear)], "rotation": [x.T.ravel().tolist() if ok else None for x, ok in zip(r, clear)]})


def view_poses(seen: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """(view_id, n, origin, rotation) of views of known points (view_id, x, y, z, u, v), from six points on; the rotation turns camera coordinates into the world's.

    A direct linear transform: 40 sums of products for each view, about its points' mean and by their spread, then the least eigenvector of a 12 x 12 matrix made of them and the
    nearest rotation. Pose is null for fewer points and where they do not tell it, as in one plane. Rows with nulls are left out; repeated ones count each.
    """
    fx, fy, cx, cy = k
    rows = seen.select("view_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "u", "v")]).dropna()
    about = rows.groupBy("view_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.sqrt(sum(F.var_pop(c) for c in "xyz")).alias("spread"), F.count("*").alias("n"))
    near = rows.join(about, "view_id")
    unit: dict[str, Column] = {c: (F.col(c) - F.col(f"m{c}")) / F.nullif(F.col("spread"), F.lit(0.0)) for c in "xyz"} | {"o": F.lit(1.0)}
    near = near.select("view_id", *[e.alias(c) for c, e in unit.items()], ((F.col("u") - cx) / fx).alias("a"), ((F.col("v") - cy) / fy).alias("b"))
    factor = {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("a") + F.col("b") * F.col("b")}
    sums = [F.sum(f * F.col(_AXES[i]) * F.col(_AXES[j])).alias(f"{name}_{_AXES[i]}{_AXES[j]}") for name, f in factor.items() for i in range(4) for j in range(i, 4)]
    kind = seen.schema["view_id"].dataType.simpleString()
    return near.groupBy("view_id").agg(*sums).na.fill(0.0).join(about, "view_id").mapInPandas(_resected, f"view_id {kind}, n long, origin array<double>, rotation array<double>")
