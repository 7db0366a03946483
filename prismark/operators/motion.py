"""Flow, inertial samples, relative motion and trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v


def flow_statistics(flow: DataFrame, tolerance: float = 3.0, keys: tuple[str, ...] = ("session_id", "frame_id")) -> DataFrame:
    """(keys, du, dv, dispersion, matches, inliers): median flow, median distance from it (our choice), counts."""
    mid = flow.groupBy(*keys).agg(F.median("du").alias("mu"), F.median("dv").alias("mv"))
    off = flow.join(mid, list(keys)).withColumn("d", F.hypot(F.col("du") - F.col("mu"), F.col("dv") - F.col("mv")))
    return off.groupBy(*keys).agg(F.first("mu").alias("du"), F.first("mv").alias("dv"), F.median("d").alias("dispersion"), F.count("*").alias("matches"), F.count_if(F.col("d") <= tolerance).alias("inliers"))


def inertial_window(samples: DataFrame, keys: tuple[str, ...] = ("session_id", "frame_id"), columns: Sequence[str] = ("gx", "gy", "gz", "ax", "ay", "az"), ts: str = "ts") -> DataFrame:
    """(keys, seconds, int_*): integrals of the samples by the trapezoid rule over each window; times in seconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(w)
    rows = samples.select(*keys, dt.alias("dt"), *[((F.col(c) + F.lag(c).over(w)) / 2 * dt).alias(c) for c in columns])
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("dt"), F.lit(0.0)).alias("seconds"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"int_{c}") for c in columns])


def dense(inputs: Sequence[Column], weights: Sequence[Sequence[float]], bias: Sequence[float], squash: bool = True) -> list[Column]:
    """One layer of a small network as unrolled columns."""
    out = [sum((F.lit(float(w)) * x for w, x in zip(row, inputs)), F.lit(float(b))) for row, b in zip(weights, bias)]
    return [F.tanh(x) for x in out] if squash else out


#: Seed weights of our own choice, untrained: (weights, bias) of a hidden layer and of the output (scale, confidence).
SEED_LAYERS = (
    (((0.2, 0.0, -0.1, 0.1), (0.0, 0.2, 0.1, -0.1), (0.1, -0.1, 0.2, 0.2)), (0.0, 0.0, 0.1)),
    (((0.05, 0.05, 0.05), (0.1, 0.1, 0.3)), (1.0, 0.5)),
)


def motion_model(inputs: Sequence[Column], layers=SEED_LAYERS) -> tuple[Column, Column]:
    """(scale, confidence) by a small perceptron; confidence is clipped to [0, 1]."""
    x = list(inputs)
    for k, (weights, bias) in enumerate(layers):
        x = dense(x, weights, bias, squash=k < len(layers) - 1)
    return x[0], F.greatest(F.lit(0.0), F.least(F.lit(1.0), x[1]))


def relative_motion(statistics: DataFrame, inertial: DataFrame, mm_per_pixel: float, keys: tuple[str, ...] = ("session_id", "frame_id"), layers=SEED_LAYERS) -> DataFrame:
    """(keys, tx, ty, tz, qw, qx, qy, qz, confidence): flow gives translation across the view, gyroscopes the rotation.

    The weight of each is our choice: the network corrects scale and confidence of the visual part, the inlier share weighs it.
    """
    both = statistics.join(inertial, list(keys))
    share = F.coalesce(F.col("inliers") / F.nullif(F.col("matches"), F.lit(0)), F.lit(0.0))
    scale, confidence = motion_model([F.col("du") / 100, F.col("dv") / 100, F.col("dispersion") / 10, share], layers)
    angle = v.norm(v.vector("int_gx", "int_gy", "int_gz"))
    half = F.when(angle > 1e-12, F.sin(angle / 2) / F.nullif(angle, F.lit(0.0))).otherwise(0.5)
    return both.select(*keys, (-F.col("du") * mm_per_pixel * scale).alias("tx"), (-F.col("dv") * mm_per_pixel * scale).alias("ty"), (F.col("int_az") * F.col("seconds") / 2 * 1000).alias("tz"), F.cos(angle / 2).alias("qw"), *[(F.col(f"int_g{c}") * half).alias(f"q{c}") for c in "xyz"], (confidence * share).alias("confidence"))


def planar_poses(steps: DataFrame, keys: tuple[str, ...] = ("session_id",), order: Sequence = ("step_id",), dx: str = "dx", dy: str = "dy", dtheta: str = "dtheta") -> DataFrame:
    """Adds x, y, theta: poses of planar motion by prefix sums; each step is turned by the heading before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(dtheta).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    turned = steps.withColumn("__t", before)
    step_x = F.col(dx) * F.cos("__t") - F.col(dy) * F.sin("__t")
    step_y = F.col(dx) * F.sin("__t") + F.col(dy) * F.cos("__t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return turned.withColumns({"x": F.sum(step_x).over(upto), "y": F.sum(step_y).over(upto), "theta": F.col("__t") + F.col(dtheta)}).drop("__t")


def accumulate_poses(motions: DataFrame, key: str = "session_id", order: str = "step_id") -> DataFrame:
    """(session_id, id, origin, rotation): t_k = t_(k-1) + R_(k-1) dt, R_k = R_(k-1) dR from the identity.

    Motions have tx, ty, tz and a rotation array r of nine. Composition does not commute, so a session is folded in order in one
    row; sessions run side by side.
    """
    step = F.struct(F.col(order).alias("at"), F.array("tx", "ty", "tz").alias("t"), F.col("r").alias("r"))
    steps = motions.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    eye = F.array(*[F.lit(1.0 if k in (0, 4, 8) else 0.0) for k in range(9)])
    pose = lambda o, r: F.struct(o.alias("origin"), r.alias("rotation"))
    start = F.array(pose(F.array(*[F.lit(0.0)] * 3), eye))

    def fold(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        o, r = v.of_array(last.origin), v.matrix_of_array(last.rotation)
        there = v.add(o, v.rotate(r, v.of_array(s.t)))
        turned = v.multiply(r, v.matrix_of_array(s.r))
        return F.concat(done, F.array(pose(F.array(*[v.positive_zero(c) for c in there]), F.array(*[v.positive_zero(c) for c in turned]))))

    return steps.select(key, F.posexplode(F.aggregate("steps", start, fold)).alias("id", "p")).select(key, F.col("id").cast("long").alias("id"), "p.origin", "p.rotation")


def frames_of_poses(poses: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, coordinateSystem, poses) with the axes of each camera, for the trajectory sink."""
    r = v.matrix_of_array("rotation")
    axes = [v.to_array(v.axis(r, k)).alias(n) for k, n in enumerate(("xAxis", "yAxis", "zAxis"))]
    rows = poses.select(key, F.struct("id", "origin", *axes).alias("p"))
    return rows.groupBy(key).agg(F.lit("right-handed-mm").alias("coordinateSystem"), F.array_sort(F.collect_list("p")).alias("poses"))


def stride(frames: DataFrame, every: int = 6, column: str = "frame_id") -> DataFrame:
    """Every sixth frame, which limits work before anything else is done."""
    return frames.where(F.col(column) % every == 0)


def frame_pairs(frames: DataFrame, key: str = "session_id", order: str = "frame_id") -> DataFrame:
    """Each frame with the one before it; the first has none and is left out."""
    w = Window.partitionBy(key).orderBy(order)
    return frames.withColumn("previous", F.lag(order).over(w)).where("previous is not null")
