"""Frames, poses and experience as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry, sessions
from ..operators.motion import stride


def live_frames(spark, path: str, schema: str, every: int = 6, files: int = 8) -> DataFrame:
    """A stream of frames from a folder: so many files a batch at most, every sixth frame."""
    return stride(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path), every)


def keep_latest(frames: DataFrame, key: str = "session_id", order: str = "frame_id") -> DataFrame:
    """Of a batch, each session's newest frame: what is left of a device that drops frames under load. For foreachBatch."""
    return frames.groupBy(key).agg(F.max_by(F.struct(*frames.columns), order).alias("x")).select("x.*")


def each_latest(frames: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Start a query that hands the newest frames of each batch to a sink."""
    return frames.writeStream.foreachBatch(lambda batch, epoch: sink(keep_latest(batch), epoch)).start()


POSE_SCHEMA = "session_id long, step_id long, x double, y double, z double, rotation array<double>, late long"


def live_poses(motions: DataFrame) -> DataFrame:
    """Poses of motions (session_id, step_id, tx, ty, tz, r) as they come, one pose held for each session.

    Within a batch a session's steps are put in order. Motions do not commute, so a step that comes after later ones were folded
    cannot be put in any more; `late` tells how many of a session's steps were left out so far.
    """
    import numpy as np
    import pandas as pd

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, origin, turn, late = state.get if state.exists else (-1, [0.0] * 3, list(np.eye(3).ravel()), 0)
        o, r = np.array(origin), np.array(turn).reshape(3, 3)
        rows = []
        for step in pd.concat(list(frames)).sort_values("step_id").itertuples():
            if step.step_id > last:
                o, r, last = o + r @ np.array([step.tx, step.ty, step.tz]), r @ np.array(step.r, float).reshape(3, 3), int(step.step_id)
                rows.append((key[0], last, *o.tolist(), r.ravel().tolist(), late))
            else:
                late += 1
        state.update((last, o.tolist(), r.ravel().tolist(), late))
        yield pd.DataFrame(rows, columns=["session_id", "step_id", "x", "y", "z", "rotation", "late"])

    return motions.groupBy("session_id").applyInPandasWithState(fold, POSE_SCHEMA, "last long, origin array<double>, turn array<double>, late long", "append", "NoTimeout")


def live_points(observations: DataFrame, poses: DataFrame, k: tuple[float, float, float, float]) -> DataFrame:
    """The points of all tracks over a stream of observations (track_id, view_id, u, v), with the poses of a table.

    A point is held as the sums of its rays' normal equations, so a track grows by what comes and nothing is looked at twice; for
    output modes update and complete. Tracks are told by the stream.
    """
    return geometry.intersect_rays(geometry.observation_rays(observations, poses, k))


def synchronised(imu: DataFrame, frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Inertial samples within their frames' windows, both streams with watermarks; times are timestamps."""
    a = imu.withWatermark("ts", delay).alias("a")
    b = frames.withWatermark("t1", delay).alias("b")
    on = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.ts") >= F.col("b.t0")) & (F.col("a.ts") <= F.col("b.t1")) & (F.col("a.ts") >= F.col("b.t1") - F.expr("interval 5 seconds"))
    return a.join(b, on).select("a.*", "b.frame_id")


def live_profile(records: DataFrame) -> DataFrame:
    """Reliability of each class over all learnable records so far; for output mode complete."""
    return sessions.learn(records)
