"""Points, lines and solids: triangulation, fits, vanishing points, relations between shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import imaging as im
from ..functions import vectors as v
from ..storage import durable


def intersect_rays(rays: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(keys, x, y, z, n) nearest to rays (ox, oy, oz, dx, dy, dz), directions unit: sums of I - d d', then a 3 x 3 solve."""
    o, d = v.vector("ox", "oy", "oz"), v.vector("dx", "dy", "dz")
    m = {(i, j): F.sum((F.lit(1.0) if i == j else F.lit(0.0)) - d[i] * d[j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)}
    along = v.dot(d, o)
    b = [F.sum(o[i] - d[i] * along).alias(f"b{i}") for i in range(3)]
    s = rays.groupBy(*keys).agg(F.count("*").alias("n"), *m.values(), *b)
    x, y, z = v.solve3(tuple(F.col(f"m{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)), v.vector("b0", "b1", "b2"))
    return s.select(*keys, x.alias("x"), y.alias("y"), z.alias("z"), "n")


def parallax(rays: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(keys, parallax): the greatest angle, in degrees, between any two rays of a track; a track's rays meet in one row."""
    d = F.collect_list(F.struct("dx", "dy", "dz"))
    dot = lambda p, q: p.dx * q.dx + p.dy * q.dy + p.dz * q.dz
    least = F.array_min(F.transform("d", lambda p: F.array_min(F.transform("d", lambda q: dot(p, q)))))
    return rays.groupBy(*keys).agg(d.alias("d")).select(*keys, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least)))).alias("parallax"))


def enough_parallax(rays: DataFrame, least_degrees: float = 1.0, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Rays of the tracks whose parallax is enough; the threshold is a parameter, its default our choice."""
    return rays.join(parallax(rays, keys).where(F.col("parallax") >= least_degrees).select(*keys), list(keys), "left_semi")


def reprojection(points: DataFrame, observations: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """(track_id, mean_error, max_error) in pixels of points over observations (track_id, u, v, rotation, ox, oy, oz)."""
    both = observations.join(points.select("track_id", "x", "y", "z"), "track_id")
    pu, pv, depth = im.project(v.vector("x", "y", "z"), k, v.matrix_of_array("rotation"), v.vector("ox", "oy", "oz"))
    error = F.when(depth > 1e-9, F.hypot(pu - F.col("u"), pv - F.col("v"))).otherwise(F.lit(float("inf")))
    return both.select("track_id", error.alias("e")).groupBy("track_id").agg(F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))


def small_reprojection(points: DataFrame, observations: DataFrame, k: tuple, most_pixels: float = 2.0) -> DataFrame:
    good = reprojection(points, observations, k).where(F.col("max_error") <= most_pixels).select("track_id")
    return points.join(good, "track_id", "left_semi")


def observation_rays(observations: DataFrame, poses: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """(track_id, view_id, ox, oy, oz, dx, dy, dz) of observations (track_id, view_id, u, v) and poses (view_id, origin, rotation)."""
    both = observations.join(poses, "view_id")
    d = im.pixel_ray("u", "v", k, v.matrix_of_array("rotation"))
    o = v.of_array("origin")
    return both.select("track_id", "view_id", *[c.alias(n) for n, c in zip(("ox", "oy", "oz", "dx", "dy", "dz"), (*o, *d))])


def moments(points: DataFrame, keys: tuple[str, ...] = (), weight: Column | None = None, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """(keys, n, mean_*, cov_*): weighted means and population covariances, in one pass with partial sums.

    Covariances are taken about the sums of the data as they are; centre far-away clouds first.
    """
    w = weight if weight is not None else F.lit(1.0)
    a = [F.col(c).cast("double") for c in axes]
    sums = [F.sum(w).alias("__w"), *[F.sum(w * x).alias(f"__s{i}") for i, x in enumerate(a)], *[F.sum(w * a[i] * a[j]).alias(f"__q{i}{j}") for i in range(3) for j in range(i, 3)]]
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    mean = [F.col(f"__s{i}") / F.col("__w") for i in range(3)]
    return s.where("n > 0").select(*keys, "n", *[mean[i].alias(f"mean_{'xyz'[i]}") for i in range(3)], *[(F.col(f"__q{i}{j}") / F.col("__w") - mean[i] * mean[j]).alias(f"cov_{'xyz'[i]}{'xyz'[j]}") for i in range(3) for j in range(i, 3)])


_EIGEN = ", ".join(f"{n} double" for n in ("l1", "l2", "l3", *(f"e{k}{c}" for k in (1, 2, 3) for c in "xyz")))


def principal_axes(moment_rows: DataFrame, keys: tuple[str, ...] = (), sweeps: int = 12) -> DataFrame:
    """Adds eigenvalues l1 >= l2 >= l3 and unit axes e1, e2, e3 to rows of `moments`, by Jacobi rotations.

    A batch of matrices is rotated at once; there is one row per cloud, so Python sees few rows.
    """
    names = [c for c in moment_rows.columns]
    cov = [f"cov_{c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz")]

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            xx, xy, xz, yy, yz, zz = (f[c].to_numpy(float) for c in cov)
            m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
            e = np.repeat(np.eye(3)[None], len(m), 0)
            for _ in range(sweeps):
                for p, q in ((0, 1), (0, 2), (1, 2)):
                    t = 0.5 * np.arctan2(2 * m[:, p, q], m[:, q, q] - m[:, p, p])
                    r = np.repeat(np.eye(3)[None], len(m), 0)
                    r[:, p, p] = r[:, q, q] = np.cos(t)
                    r[:, p, q], r[:, q, p] = np.sin(t), -np.sin(t)
                    m, e = r.transpose(0, 2, 1) @ m @ r, e @ r
            values = np.einsum("nii->ni", m)
            order = np.argsort(-values, 1, kind="stable")
            values = np.take_along_axis(values, order, 1)
            e = np.take_along_axis(e, order[:, None, :], 2)
            lead = np.take_along_axis(e, np.abs(e).argmax(1)[:, None, :], 1)
            e = e * np.where(lead < 0, -1.0, 1.0)  # the greatest component is positive
            out = {f"l{k + 1}": values[:, k] for k in range(3)} | {f"e{k + 1}{'xyz'[c]}": e[:, c, k] for k in range(3) for c in range(3)}
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out)], axis=1)[[*names, *out]]

    schema = ", ".join([*(f"{n} {t}" for n, t in moment_rows.dtypes), _EIGEN])
    return moment_rows.mapInPandas(run, schema)


def _weight(residual: Column, cut: Column) -> Column:
    """Tukey's biweight, our choice of robust weight."""
    r = residual / F.nullif(cut, F.lit(0.0))
    return F.when(cut == 0, F.when(residual == 0, 1.0).otherwise(0.0)).when(F.abs(r) >= 1, 0.0).otherwise((1 - r * r) * (1 - r * r))


def _extent(points: DataFrame, fit: DataFrame, keys: list[str], axes: dict[str, v.Vector]) -> DataFrame:
    rel = v.subtract(v.vector("x", "y", "z"), v.vector("mean_x", "mean_y", "mean_z"))
    aggs = [f(v.dot(rel, e)).alias(f"{n}_{name}") for name, e in axes.items() for n, f in (("min", F.min), ("max", F.max))]
    return points.join(fit, keys).groupBy(*keys).agg(*aggs)


def fit_planes(points: DataFrame, keys: tuple[str, ...] = ("cloud_id",), rounds: int = 4) -> DataFrame:
    """(keys, nx, ny, nz, bx, by, bz, size1, size2, residual, confidence): planes by reweighted principal axes.

    Extents run along the two larger axes, the base is the corner of their least ends; residual is the root mean square of
    distances, confidence exp(-residual / (5 % of the larger extent)), our choice.
    """
    keys_ = list(keys)
    fit = principal_axes(moments(points, keys), keys)
    dist = lambda: v.dot(v.subtract(v.vector("x", "y", "z"), v.vector("mean_x", "mean_y", "mean_z")), v.vector("e3x", "e3y", "e3z"))
    for _ in range(rounds):
        near = points.join(fit.select(*keys, "mean_x", "mean_y", "mean_z", "e3x", "e3y", "e3z"), keys_).withColumn("__d", dist())
        cut = near.groupBy(*keys).agg((F.expr("percentile_approx(abs(__d), 0.5, 10000)") * 6 + 1e-9).alias("__cut"))
        near = near.join(cut, keys_).select(*keys, "x", "y", "z", _weight(F.col("__d"), F.col("__cut")).alias("__weight"))
        fit = durable(principal_axes(moments(near, keys, F.col("__weight")), keys), "planes")
    extent = _extent(points, fit, keys_, {"a": v.vector("e1x", "e1y", "e1z"), "b": v.vector("e2x", "e2y", "e2z")})
    res = points.join(fit, keys_).groupBy(*keys).agg(F.sqrt(F.avg(dist() * dist())).alias("residual"))
    out = fit.join(extent, keys_).join(res, keys_)
    base = v.add(v.add(v.vector("mean_x", "mean_y", "mean_z"), v.scale(v.vector("e1x", "e1y", "e1z"), "min_a")), v.scale(v.vector("e2x", "e2y", "e2z"), "min_b"))
    size1, size2 = F.col("max_a") - F.col("min_a"), F.col("max_b") - F.col("min_b")
    return out.select(*keys, F.col("e3x").alias("nx"), F.col("e3y").alias("ny"), F.col("e3z").alias("nz"), *[b.alias(n) for b, n in zip(base, ("bx", "by", "bz"))], size1.alias("size1"), size2.alias("size2"), "residual", F.exp(-F.col("residual") / F.nullif(0.05 * F.greatest(size1, size2), F.lit(0.0))).alias("confidence"))


def fit_cylinders(points: DataFrame, keys: tuple[str, ...] = ("cloud_id",), rounds: int = 6) -> DataFrame:
    """(keys, ax, ay, az, bx, by, bz, size1 radius, size2 height, residual, confidence).

    The axis starts as the principal axis whose two others have the most alike eigenvalues; a Gauss-Newton step on (centre,
    tilt, radius) is a sum of normal equations per cloud, robustly weighted; six unknowns are solved in a batch. The base
    is the axis point at the least end.
    """
    import numpy as np
    import pandas as pd

    keys_ = list(keys)
    start = principal_axes(moments(points, keys), keys)
    ratio = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.nullif(F.col(a) + F.col(b), F.lit(0.0))
    pick = lambda c: F.when(F.least(ratio("l2", "l3"), ratio("l1", "l2"), ratio("l1", "l3")) == ratio("l2", "l3"), F.col(f"e1{c}")).when(F.least(ratio("l1", "l2"), ratio("l1", "l3")) == ratio("l1", "l2"), F.col(f"e3{c}")).otherwise(F.col(f"e2{c}"))
    fit = start.select(*keys, *[F.col(f"mean_{c}").alias(f"c{c}") for c in "xyz"], *[pick(c).alias(f"a{c}") for c in "xyz"])
    rel = lambda: v.subtract(v.vector("x", "y", "z"), v.vector("cx", "cy", "cz"))
    axis_ = v.vector("ax", "ay", "az")

    def radial() -> v.Vector:
        return v.subtract(rel(), v.scale(axis_, v.dot(rel(), axis_)))

    fit = durable(points.join(fit, keys_).groupBy(*keys, *[f"{p}{c}" for p in "ca" for c in "xyz"]).agg(F.avg(v.norm(radial())).alias("radius")), "cylinders")
    names = [*keys, "cx", "cy", "cz", "ax", "ay", "az", "radius"]
    types = {n: t for n, t in fit.dtypes}
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    n_par = 7

    def solve(frames):
        for f in frames:
            a = np.zeros((len(f), n_par, n_par))
            for i in range(n_par):
                for j in range(i, n_par):
                    a[:, i, j] = a[:, j, i] = f[f"h{i}{j}"].to_numpy(float)
            b = np.stack([f[f"g{i}"].to_numpy(float) for i in range(n_par)], 1)
            scale = np.einsum("nii->ni", a)
            a += np.einsum("ni,ij->nij", scale * 1e-9 + 1e-12, np.eye(n_par))
            step = np.stack([np.linalg.lstsq(x, y, rcond=1e-10)[0] for x, y in zip(a, b)]) if len(f) else b
            out = f.copy()
            for k, c in enumerate(("cx", "cy", "cz", "ax", "ay", "az", "radius")):
                out[c] = out[c] - step[:, k]
            length = np.sqrt(out["ax"] ** 2 + out["ay"] ** 2 + out["az"] ** 2)
            for c in ("ax", "ay", "az"):
                out[c] = out[c] / length
            yield pd.DataFrame(out[names])

    for _ in range(rounds):
        q = radial()
        dist = v.norm(q)
        near = points.join(fit, keys_).withColumn("__e", dist - F.col("radius"))
        cut = near.groupBy(*keys).agg((F.expr("percentile_approx(abs(__e), 0.5, 10000)") * 6 + 1e-9).alias("__cut"))
        u = v.unit(radial())
        t = v.dot(rel(), axis_)
        grad = [*[-x for x in u], *[-x * t for x in u], F.lit(-1.0)]
        near = near.join(cut, keys_).select(*names, "__e", _weight(F.col("__e"), F.col("__cut")).alias("__w"), *[F.coalesce(g, F.lit(0.0)).alias(f"__j{i}") for i, g in enumerate(grad)])
        j = [F.col(f"__j{i}") for i in range(n_par)]
        normal = near.groupBy(*names).agg(*[F.sum(F.col("__w") * j[a] * j[b]).alias(f"h{a}{b}") for a in range(n_par) for b in range(a, n_par)], *[F.sum(F.col("__w") * j[a] * F.col("__e")).alias(f"g{a}") for a in range(n_par)])
        fit = durable(normal.mapInPandas(solve, schema), "cylinders")
    t, e = v.dot(rel(), axis_), v.norm(radial()) - F.col("radius")
    out = points.join(fit, keys_).groupBy(*names).agg(F.min(t).alias("__a"), F.max(t).alias("__b"), F.sqrt(F.avg(e * e)).alias("residual"))
    base = v.add(v.vector("cx", "cy", "cz"), v.scale(axis_, "__a"))
    return out.select(*keys, "ax", "ay", "az", *[x.alias(n) for x, n in zip(base, ("bx", "by", "bz"))], F.col("radius").alias("size1"), (F.col("__b") - F.col("__a")).alias("size2"), "residual", F.exp(-F.col("residual") / F.nullif(0.05 * F.col("radius"), F.lit(0.0))).alias("confidence"))


def line_residual(u, w) -> Column:
    """How far a point (u, w) is from a unit-normal line (la, lb, lc)."""
    return F.abs(F.col("la") * u + F.col("lb") * w + F.col("lc"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """Adds the homogeneous line la, lb, lc of (x1, y1, x2, y2), its normal unit; points are no lines."""
    a, b, c = v.homogeneous_line("x1", "y1", "x2", "y2")
    n = F.nullif(F.hypot(a, b), F.lit(0.0))
    return segments.withColumns({"la": a / n, "lb": b / n, "lc": c / n}).where("la is not null")


def vanishing_points(segments: DataFrame, most: int = 3, hypotheses: int = 64, tolerance: float = 2.0, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """(keys, vp, u, v, inliers, confidence): up to `most` points where families of segments meet, one after another.

    Hypotheses are meetings of pairs taken by hash, so a run repeats itself; each round counts inliers of every hypothesis
    in its view, takes the best, refines it by least squares over its inliers, and goes on without them.
    """
    keys_ = list(keys)
    rest = segment_lines(segments).withColumn("__id", F.xxhash64(*[F.col(c) for c in segments.columns]))
    found = None
    for k in range(most):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("__id", F.lit(k)), "__id")
        drawn = rest.withColumn("__at", F.row_number().over(order) - 1).where(F.col("__at") < 2 * hypotheses)
        a = drawn.where("__at % 2 = 0").select(*keys, F.shiftright("__at", 1).alias("h"), *[F.col(c).alias(f"p{c}") for c in ("la", "lb", "lc")])
        b = drawn.where("__at % 2 = 1").select(*keys, F.shiftright("__at", 1).alias("h"), *[F.col(c).alias(f"q{c}") for c in ("la", "lb", "lc")])
        x, y, w = v.cross(v.vector("pla", "plb", "plc"), v.vector("qla", "qlb", "qlc"))
        safe = F.nullif(w, F.lit(0.0))
        hyp = a.join(b, [*keys_, "h"]).where(F.abs(w) > 1e-9).select(*keys, "h", (x / safe).alias("u"), (y / safe).alias("v"))
        votes = rest.join(F.broadcast(hyp) if not keys else hyp, keys_).where(line_residual(F.col("u"), F.col("v")) < tolerance)
        best = votes.groupBy(*keys, "h", "u", "v").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.struct("n", (-F.col("h")).alias("h"), "u", "v")).alias("b")).select(*keys, F.col("b.u").alias("u0"), F.col("b.v").alias("v0"))
        marked = rest.join(best, keys_, "left").withColumn("__in", F.coalesce(line_residual(F.col("u0"), F.col("v0")) < tolerance, F.lit(False)))
        one = refine_points(marked.where("__in"), keys).withColumn("vp", F.lit(k))
        total = marked.groupBy(*keys).agg(F.count("*").alias("__all"))
        one = one.join(total, keys_).withColumn("confidence", F.col("inliers") / F.col("__all")).drop("__all")
        found = one if found is None else found.unionByName(one)
        rest = durable(marked.where("not __in").select(*rest.columns), "segments")
    return found.select(*keys, "vp", "u", "v", "inliers", "confidence")


def refine_points(lines: DataFrame, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """(keys, u, v, inliers) nearest to all lines (la, lb, lc): sums of normal equations, then a 2 x 2 solve."""
    s = lines.groupBy(*keys).agg(F.count("*").alias("inliers"), F.sum(F.col("la") * F.col("la")).alias("aa"), F.sum(F.col("la") * F.col("lb")).alias("ab"), F.sum(F.col("lb") * F.col("lb")).alias("bb"), F.sum(F.col("la") * F.col("lc")).alias("ac"), F.sum(F.col("lb") * F.col("lc")).alias("bc"))
    det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
    return s.select(*keys, ((F.col("ab") * F.col("bc") - F.col("bb") * F.col("ac")) / det).alias("u"), ((F.col("ab") * F.col("ac") - F.col("aa") * F.col("bc")) / det).alias("v"), "inliers")


def perspective_frames(points: DataFrame, k: tuple[float, float, float, float], keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """(keys, coordinateSystem, axes, confidence, vanishingPoints, geometryCandidates) from vanishing points by vp.

    One point gives an extrusion axis, two a plane, three a box; two or more give a frame, whose Z is across both.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("vp", "u", "v", "confidence")))
    rows = points.groupBy(*keys).agg(sorted_.alias("p")).withColumn("vanishingPoints", F.transform("p", lambda p: F.struct(p.u.alias("u"), p.v.alias("v"), p.confidence.alias("confidence"))))
    at = lambda n, f: F.try_element_at("vanishingPoints", F.lit(n))[f]
    # step by step, as columns: one expression for all of it would repeat its parts thousands of times
    for k_ in (1, 2):
        rows = rows.withColumns({f"__d{k_}{i}": c for i, c in enumerate(im.pixel_direction(at(k_, "u"), at(k_, "v"), *k))})
    named = lambda p: v.vector(*[f"__{p}{i}" for i in range(3)])
    rows = rows.withColumns({f"__x{i}": c for i, c in enumerate(v.unit(named("d1")))})
    rows = rows.withColumn("__t", v.dot(named("d2"), named("x")))
    rows = rows.withColumns({f"__w{i}": c for i, c in enumerate(v.subtract(named("d2"), v.scale(named("x"), "__t")))})
    rows = rows.withColumns({f"__y{i}": c for i, c in enumerate(v.scale(v.unit(named("w")), -1.0))})
    x, y = named("x"), named("y")
    z = v.cross(x, y)
    c1, c2, c3 = at(1, "confidence"), at(2, "confidence"), at(3, "confidence")
    n = F.size("vanishingPoints")
    candidate = lambda kind, name, conf: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), conf.alias("confidence"))
    every = F.array(candidate("extrusion_axis", "EjeExtrusion", im.extrusion_confidence(c1)), candidate("plane", "PlanoPerspectivo", im.plane_confidence(c1, c2)), candidate("box", "PrismaCartesiano", im.box_confidence(c1, c2, c3)))
    confidence = F.when(n >= 3, im.frame_confidence(c1, c2, c3)).when(n == 2, im.plane_confidence(c1, c2)).otherwise(c1)
    return rows.select(*keys, F.lit("camera-right-handed").alias("coordinateSystem"), *[v.to_array(tuple(v.positive_zero(c) for c in a)).alias(name) for a, name in ((x, "xAxis"), (y, "yAxis"), (z, "zAxis"))], confidence.alias("confidence"), "vanishingPoints", F.slice(every, 1, F.least(n, F.lit(3))).alias("geometryCandidates"))


def fuse_frames(frames: DataFrame, poses: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(keys, xAxis, yAxis, zAxis, views): frames of several poses as one, in the world.

    Axes are turned by their poses, aligned in sign with the session's first, summed by confidence and made orthogonal; the
    method is our choice.
    """
    both = frames.join(poses.select("view_id", "rotation"), "view_id")
    r = v.matrix_of_array("rotation")
    turned = both.select(*keys, "view_id", "confidence", *[c.alias(f"{n}{i}") for n in "xy" for i, c in enumerate(v.rotate(r, v.of_array(f"{n}Axis")))])
    first = Window.partitionBy(*keys).orderBy("view_id")
    sums = []
    for n in "xy":
        for i in range(3):
            turned = turned.withColumn(f"f{n}{i}", F.first(f"{n}{i}").over(first))
        sign = F.when(v.dot(v.vector(*[f"{n}{i}" for i in range(3)]), v.vector(*[f"f{n}{i}" for i in range(3)])) < 0, -1.0).otherwise(1.0)
        sums += [F.sum(F.col("confidence") * sign * F.col(f"{n}{i}")).alias(f"s{n}{i}") for i in range(3)]
    s = turned.groupBy(*keys).agg(*sums, F.count("*").alias("views"))
    x = v.unit(v.vector("sx0", "sx1", "sx2"))
    ys = v.vector("sy0", "sy1", "sy2")
    y = v.unit(v.subtract(ys, v.scale(x, v.dot(x, ys))))
    return s.select(*keys, v.to_array(x).alias("xAxis"), v.to_array(y).alias("yAxis"), v.to_array(v.cross(x, y)).alias("zAxis"), "views")


def shape_relations(shapes: DataFrame, key: str = "assembly", tolerance: float = 5.0, degrees: float = 3.0) -> DataFrame:
    """(assembly, a_id, b_id, relation) between shapes (shape_id, kind, x, y, z, ax, ay, az, radius, height).

    Coaxial: parallel axes with each centre on the other's axis; concentric: coaxial with one centre; contains: concentric
    or coaxial with a larger radius and height; supports: what stands on top of it; attached: surfaces that touch. The predicates
    are our choice. Pairs are formed within an assembly.
    """
    a, b = shapes.alias("a"), shapes.alias("b")
    c = lambda s, *ns: v.vector(*[f"{s}.{n}" for n in ns])
    ca, cb, da, db = c("a", "x", "y", "z"), c("b", "x", "y", "z"), c("a", "ax", "ay", "az"), c("b", "ax", "ay", "az")
    gap = v.subtract(cb, ca)
    parallel = F.abs(v.dot(da, db)) >= F.cos(F.radians(F.lit(degrees)))
    t = v.dot(gap, da)
    off = v.norm(v.subtract(gap, v.scale(da, t)))
    coaxial = parallel & (off <= tolerance)
    wider, higher = F.col("a.radius") - F.col("b.radius"), F.col("a.height") - F.col("b.height")
    ends = (F.col("a.height") + F.col("b.height")) / 2
    inside = coaxial & (F.abs(t) + F.least(F.col("a.height"), F.col("b.height")) / 2 <= F.greatest(F.col("a.height"), F.col("b.height")) / 2 + tolerance) & (wider * higher > 0)
    touching = parallel & (F.abs(F.abs(t) - ends) <= tolerance)
    relations = [("coaxial", coaxial), ("concentric", coaxial & (v.norm(gap) <= tolerance)), ("contains", inside), ("supports", touching & coaxial), ("attached", touching & (off <= F.col("a.radius") + F.col("b.radius") + tolerance))]
    names = F.filter(F.array(*[F.when(p, n) for n, p in relations]), lambda x: x.isNotNull())
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.shape_id") < F.col("b.shape_id")))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("a.shape_id").alias("a_id"), F.col("b.shape_id").alias("b_id"), F.explode(names).alias("relation"))


def radial_repetition(shapes: DataFrame, key: str = "assembly", least: int = 3, tolerance: float = 5.0) -> DataFrame:
    """(assembly, kind, count, ring): equal shapes at one distance around their common centre; linear in shapes."""
    centre = shapes.groupBy(key, "kind").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    far = shapes.join(centre, [key, "kind"]).withColumn("d", v.norm(v.subtract(v.vector("x", "y", "z"), v.vector("mx", "my", "mz"))))
    ring = far.groupBy(key, "kind").agg(F.count("*").alias("count"), F.avg("d").alias("ring"), (F.max("d") - F.min("d")).alias("spread"))
    return ring.where((F.col("count") >= least) & (F.col("ring") > tolerance) & (F.col("spread") <= tolerance)).drop("spread")


#: The named classes of the vocabulary; how it goes on to twenty and more is not given.
CLASSES = ("CYLINDER", "DISC", "ANNULUS", "PLATE", "RECTANGULAR_PRISM", "ARCHED_HOUSING", "HOLE", "BOLT_PATTERN", "GEAR_DISC", "GEAR_TEETH", "FILLET", "CHAMFER", "LAGGING_TILES", "GRID_PATTERN", "SHAFT")
#: Compound parts and what they are made of; our choice of a rule table.
PARTS = {"PULLEY": ("CYLINDER", "SHAFT", "DISC", "DISC", "ANNULUS", "BOLT_PATTERN"), "GEAR": ("GEAR_DISC", "GEAR_TEETH", "HOLE"), "BEARING_HOUSING": ("ARCHED_HOUSING", "ANNULUS", "HOLE", "RECTANGULAR_PRISM")}


def canonical_class(x) -> Column:
    """Upper case with underscores; null for what the vocabulary does not have."""
    name = F.upper(F.regexp_replace(F.trim(v.col(x)), r"[\s-]+", "_"))
    return F.when(name.isin(*CLASSES, *PARTS), name)


def decompose(shapes: DataFrame, kind: str = "class") -> DataFrame:
    """Compound parts as their parts: adds part and part_no; simple shapes are their own only part."""
    rules = F.create_map(*[x for name, parts in PARTS.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in parts]))])
    return shapes.select("*", F.posexplode(F.coalesce(F.try_element_at(rules, F.col(kind)), F.array(F.col(kind)))).alias("part_no", "part"))


def hypotheses(evidence: DataFrame) -> DataFrame:
    """(view_id, type, label, confidence) from (view_id, lines, ellipses, vps); the rules are our choice."""
    one = lambda kind, label, conf, when: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), conf.alias("confidence")))
    cap = lambda x: F.least(F.lit(0.95), x)
    rules = F.array(one("BOX", "Prisma posible", cap(F.lit(0.52) + 0.1 * F.col("vps")), F.col("vps") >= 3), one("PLANE", "Plano posible", cap(F.lit(0.42) + 0.1 * F.col("vps")), F.col("vps") >= 2), one("CYLINDER", "Cilindro posible", cap(F.lit(0.5) + 0.1 * F.col("ellipses")), (F.col("ellipses") >= 1) & (F.col("lines") >= 2)))
    return evidence.select("view_id", F.inline(F.filter(rules, lambda r: r.isNotNull())))


def base_proposal(boxes: DataFrame) -> DataFrame:
    """(view_id, type, label, visualConfidence) of the largest rectangular region (view_id, x1, y1, x2, y2, fill) of a view."""
    w, h = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    best = boxes.groupBy("view_id").agg(F.max(F.struct((w * h).alias("area"), "fill", w.alias("w"), h.alias("h"))).alias("b"))
    ratio = F.greatest("b.w", "b.h") / F.nullif(F.least("b.w", "b.h").cast("double"), F.lit(0.0))
    return best.select("view_id", F.lit("BOX").alias("type"), F.when(ratio < 1.1, "Base cuadrada propuesta").otherwise("Base rectangular propuesta").alias("label"), F.least(F.lit(0.95), F.col("b.fill")).alias("visualConfidence"))
