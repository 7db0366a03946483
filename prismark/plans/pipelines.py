"""Stereo, multi-view, perspective and experience pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging as im
from ..functions import vectors as v
from ..operators import geometry, graphs, motion, segments, sessions


def stereo_cloud(left: DataFrame, right: DataFrame, f: float, baseline_mm: float, cx: float, cy: float, most_row_gap: float = 1.5) -> DataFrame:
    """(pair_id, a_id, b_id, x, y, z) of two rectified views' features (pair_id, feat_id, u, v, desc)."""
    found = graphs.match_views(left, right)
    both = found.join(left.select("pair_id", F.col("feat_id").alias("a_id"), "u", "v"), ["pair_id", "a_id"]).join(right.select("pair_id", F.col("feat_id").alias("b_id"), F.col("u").alias("u2"), F.col("v").alias("v2")), ["pair_id", "b_id"])
    both = both.where((F.abs(F.col("v") - F.col("v2")) <= most_row_gap) & (F.col("u") > F.col("u2")))
    x, y, z = im.stereo_point("u", "v", F.col("u") - F.col("u2"), f, baseline_mm, cx, cy)
    return both.select("pair_id", "a_id", "b_id", x.alias("x"), y.alias("y"), z.alias("z"))


def multi_view_cloud(observations: DataFrame, poses: DataFrame, k: tuple[float, float, float, float], least_parallax: float = 1.0, most_pixels: float = 2.0, lens: tuple | None = None) -> DataFrame:
    """(track_id, x, y, z, n) in mm: observations, freed of their lens where one is given, to rays, least-squares points, parallax and reprojection filters."""
    observations = observations if lens is None else im.undistorted(observations, k, lens)
    rays = geometry.enough_parallax(geometry.observation_rays(observations, poses, k), least_parallax)
    points = geometry.intersect_rays(rays)
    o = v.of_array("origin")
    seen = observations.join(poses, "view_id").select("track_id", "u", "v", "rotation", *[c.alias(n) for n, c in zip(("ox", "oy", "oz"), o)])
    return geometry.small_reprojection(points, seen, k, most_pixels)


def image_to_candidates(pixels: DataFrame, k: tuple[float, float, float, float], edge_threshold: float, least_span: int = 3, tolerance: float = 2.0) -> DataFrame:
    """Frames and CAD candidates of images (view_id, r, c, g): edges, runs both ways, vanishing points, frame."""
    mask = segments.edges(pixels, edge_threshold)
    across = segments.runs(mask, least_span).select("view_id", F.col("x1").cast("double").alias("x1"), F.col("r").cast("double").alias("y1"), F.col("x2").cast("double").alias("x2"), F.col("r").cast("double").alias("y2"))
    down = segments.runs(mask, least_span, keys=("view_id", "c"), at="r").select("view_id", F.col("c").cast("double").alias("x1"), F.col("x1").cast("double").alias("y1"), F.col("c").cast("double").alias("x2"), F.col("x2").cast("double").alias("y2"))
    return geometry.perspective_frames(geometry.vanishing_points(across.unionByName(down), tolerance=tolerance), k)


def trajectory(flow: DataFrame, imu: DataFrame, frames: DataFrame, mm_per_pixel: float) -> DataFrame:
    """(session_id, coordinateSystem, poses): flow and inertial windows to relative motions to poses."""
    stats = motion.flow_statistics(flow)
    window = motion.inertial_window(graphs.interval_join(imu, frames, ("session_id",)))
    moves = motion.relative_motion(stats, window, mm_per_pixel)
    r = v.quaternion_to_matrix("qw", "qx", "qy", "qz")
    return motion.frames_of_poses(motion.accumulate_poses(moves.withColumn("r", F.array(*r)).withColumnRenamed("frame_id", "step_id")))


def personalised(detections: DataFrame, records: DataFrame, top: int = 8, key: str = "session_id") -> DataFrame:
    """The best detections of each session after experience has moved their confidence."""
    ranked = sessions.rerank(detections, sessions.learn(records))
    return segments.top_k(ranked, [F.desc("adjusted"), "class"], top, (key,))
