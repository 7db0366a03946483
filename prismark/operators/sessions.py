"""Capture sessions, dimensions and experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import imaging as im

# What a session should have, and from what quality on it is learned from.
PHOTOS_SUGGESTED, PHOTOS_LEAST, PHOTOS_MOST, OVERLAP, HEIGHTS, SCALE_SHOTS = 12, 18, 36, 0.70, 2, 3
LEARN_QUALITY = 0.65
#: Prior successes and failures of a class's reliability; our choice.
ALPHA, BETA = 4.0, 4.0


def capture_progress(photos: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, photos, enough) against the suggested number."""
    return photos.groupBy(key).agg(F.count("*").alias("photos")).withColumn("enough", F.col("photos") >= PHOTOS_SUGGESTED)


def capture_policy(shots: DataFrame, key: str = "session_id") -> DataFrame:
    """(session_id, photos, accepted) of shots (session_id, overlap, height_id, scale_visible)."""
    s = shots.groupBy(key).agg(F.count("*").alias("photos"), F.min("overlap").alias("overlap"), F.countDistinct("height_id").alias("heights"), F.count_if("scale_visible").alias("scaled"))
    return s.select(key, "photos", (F.col("photos").between(PHOTOS_LEAST, PHOTOS_MOST) & (F.col("overlap") > OVERLAP) & (F.col("heights") >= HEIGHTS) & (F.col("scaled") >= SCALE_SHOTS)).alias("accepted"))


def with_manual_dimensions(parts: DataFrame, manual: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Parts with what the operator entered in place of what was estimated."""
    entered = manual.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return parts.join(entered, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def segment_scale(dimensions: DataFrame, segments: DataFrame, key: str = "segment_id") -> DataFrame:
    """Dimensions (segment_id, millimetres, confidence) with their segments and mm per pixel."""
    return dimensions.join(segments, key).withColumn("scale", im.mm_per_pixel("millimetres", "x1", "y1", "x2", "y2"))


def estimate_scale(scaled: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(keys, scale, n): mean of the dimensions' scales, weighted by confidence, which is our choice."""
    return scaled.where("scale is not null").groupBy(*keys).agg((F.sum(F.col("scale") * F.col("confidence")) / F.nullif(F.sum("confidence"), F.lit(0.0))).alias("scale"), F.count("*").alias("n"))


def refine_model(proposals: DataFrame, scales: DataFrame, key: str = "session_id") -> DataFrame:
    """Proposals (session_id, visualConfidence, length_px, width_px, height_px) in millimetres, once calibrated."""
    j = proposals.join(scales, key, "left")
    return j.select(key, F.col("scale").isNotNull().alias("metricCalibrated"), F.col("scale").alias("scaleMmPerPixel"), *[(F.col(f"{d}_px") * F.col("scale")).alias(f"{d}Mm") for d in ("length", "width", "height")], im.refined_confidence("visualConfidence", F.coalesce("n", F.lit(0))).alias("confidence"))


def model_state(calibrated: Column, accepted: Column) -> Column:
    """visual hypothesis, accepted or calibrated; the order of the tests is our choice."""
    return F.when(calibrated, "calibrated").when(accepted, "accepted").otherwise("visual_hypothesis")


def next_capture(calibrated: Column, views: Column) -> Column:
    """Struct (instruction, reason): what to do next; the rules are our choice."""
    say = lambda a, b: F.struct(F.lit(a).alias("instruction"), F.lit(b).alias("reason"))
    return F.when(~calibrated, say("Marca la base e ingresa una medida real", "Falta escala métrica")).when(views < 3, say("Muévete 25 grados hacia la derecha manteniendo visible la base", "Se necesita paralaje para calcular profundidad")).otherwise(say("Captura completa", "Hay vistas y escala suficientes"))


def learnable(records: DataFrame) -> DataFrame:
    """What may be learned from: confirmed by the operator, and of enough quality."""
    return records.where(F.col("confirmed") & (F.col("quality") >= LEARN_QUALITY))


def reliability(records: DataFrame, keys: tuple[str, ...] = ("class",), alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(keys, n, reliability): share of right predictions (column ok), smoothed by a prior, so one record moves little."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("__ok")).select(*keys, "n", ((F.col("__ok") + alpha) / (F.col("n") + alpha + beta)).alias("reliability"))


def rerank(detections: DataFrame, profile: DataFrame, key: str = "class", **law) -> DataFrame:
    """Detections with `adjusted`, their confidence moved within bounds by the profile; order by it falling."""
    return detections.join(profile.select(key, "reliability"), key, "left").withColumn("adjusted", im.adjusted_confidence("confidence", "reliability", **law)).drop("reliability")


def learn(records: DataFrame, **prior) -> DataFrame:
    """A profile from the sessions that may be learned from."""
    rows = learnable(records).withColumn("ok", F.col("predicted").eqNullSafe(F.col("class")))
    return reliability(rows, **prior)


def passport(records: DataFrame, key: str = "device_id") -> DataFrame:
    """(device_id, sessions, confirmed, corrections, mean_quality, maturity): maturity in 0..100 by a law of our choice."""
    s = records.groupBy(key).agg(F.countDistinct("session_id").alias("sessions"), F.count_if("confirmed").alias("confirmed"), F.count_if(F.col("confirmed") & ~F.col("predicted").eqNullSafe(F.col("class"))).alias("corrections"), F.avg("quality").alias("mean_quality"))
    return s.withColumn("maturity", 100 * (1 - F.exp(-F.col("confirmed") / 50.0)) * F.coalesce("mean_quality", F.lit(0.0)))


def assembly_confidence(shapes: DataFrame, key: str = "assembly", weight: str | None = None) -> DataFrame:
    """(assembly, confidence, shapes): mean confidence, weighted by a column if one is given."""
    w = F.col(weight) if weight else F.lit(1.0)
    return shapes.groupBy(key).agg((F.sum(F.col("confidence") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("confidence"), F.count("*").alias("shapes"))


def keep_both(ai: DataFrame, manual: DataFrame) -> DataFrame:
    """Machine hypotheses and manual constraints in one table, told apart by `origin`; neither replaces the other."""
    return ai.withColumn("origin", F.lit("ai")).unionByName(manual.withColumn("origin", F.lit("manual")), allowMissingColumns=True)
