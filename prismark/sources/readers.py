"""Readers: JSON documents with fixed schemas, ASCII point clouds, drawings, text reports, photos.

Reading clouds, drawings and reports is our addition; the formats are those that the sinks write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_V = "array<double>"
SCHEMAS = {
    "trajectory": f"coordinateSystem string, poses array<struct<id: bigint, origin: {_V}, xAxis: {_V}, yAxis: {_V}, zAxis: {_V}>>",
    "reconstruction": f"coordinateSystem string, poses array<struct<id: bigint, origin: {_V}, rotation: {_V}>>, points array<{_V}>, vectors array<struct<name: string, origin: {_V}, direction: {_V}, lengthMm: double, confidence: double>>",
    "perspective": f"coordinateSystem string, xAxis {_V}, yAxis {_V}, zAxis {_V}, confidence double, vanishingPoints array<struct<u: double, v: double, confidence: double>>, geometryCandidates array<struct<type: string, name: string, confidence: double>>",
    "constraints": f"coordinateSystem string, aiHypotheses array<struct<type: string, label: string, confidence: double>>, manualConstraints array<struct<type: string, points: {_V}, bounds: {_V}, meaning: string>>",
    "refinement": f"proposal struct<type: string, label: string, visualConfidence: double>, realDimensions array<struct<kind: string, imageSegment: {_V}, millimetres: double, confidence: double>>, refinedModel struct<metricCalibrated: boolean, scaleMmPerPixel: double, lengthMm: double, widthMm: double, heightMm: double, confidence: double>, nextCapture struct<instruction: string, reason: string>",
    "annotations": "image string, tags array<string>, parts array<struct<id: bigint, class: string, parent: bigint>>",
}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per document of a kind in SCHEMAS."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path)


#: Inertial samples: rates in rad/s, accelerations in m/s2 without gravity, and the rotation vector as a quaternion.
IMU_SCHEMA = "session_id bigint, ts timestamp, " + ", ".join(f"{n} double" for n in ("gx", "gy", "gz", "ax", "ay", "az", "qw", "qx", "qy", "qz"))


def read_imu(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Inertial samples of a folder of JSON lines, at rest or as they come; also t, the time in seconds, for windows at rest."""
    source = spark.readStream if stream else spark.read
    return source.schema(IMU_SCHEMA).json(path).withColumn("t", F.unix_micros("ts") / 1e6)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, tags, part_id, class, parent) of annotated images, a row a part; classes in the vocabulary's spelling, null if it has none."""
    from ..operators.geometry import canonical_class

    doc = read_json(spark, path, "annotations").select("image", "tags", F.explode_outer("parts").alias("p"))
    return doc.select("image", "tags", F.col("p.id").alias("part_id"), canonical_class(F.col("p.class")).alias("class"), F.col("p.parent").alias("parent"))


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """(origin, type, points, bounds, meaning, confidence): machine hypotheses and manual constraints, both kept."""
    doc = read_json(spark, path, "constraints")
    none = F.lit(None)
    ai = doc.select(F.explode("aiHypotheses").alias("h")).select(F.lit("ai").alias("origin"), "h.type", none.cast(_V).alias("points"), none.cast(_V).alias("bounds"), F.col("h.label").alias("meaning"), "h.confidence")
    manual = doc.select(F.explode("manualConstraints").alias("c")).select(F.lit("manual").alias("origin"), "c.type", "c.points", "c.bounds", "c.meaning", none.cast("double").alias("confidence"))
    return ai.unionByName(manual)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each file whole in a row, then a row a line, so that order never depends on splits."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return text.select("file", F.posexplode("lines").alias("line", "value"))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(file, point_id, x, y, z) of ASCII clouds."""
    lines = _numbered_lines(spark, path)
    heads = lines.where("value = 'end_header'").groupBy("file").agg(F.min("line").alias("head"))
    parts = F.split(F.trim("value"), r"\s+")
    body = lines.join(heads, "file").where("line > head and trim(value) <> ''")
    return body.select("file", (F.col("line") - F.col("head") - 1).cast("long").alias("point_id"), *[F.try_element_at(parts, F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyz")])


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """(file, entity_id, layer, x1, y1, x2, y2) of a drawing's LINE entities, from its pairs of code and value."""
    lines = _numbered_lines(spark, path)
    pairs = lines.groupBy("file", F.shiftright("line", 1).alias("pair")).agg(F.max(F.when(F.col("line") % 2 == 0, F.trim("value"))).alias("code"), F.max(F.when(F.col("line") % 2 == 1, F.trim("value"))).alias("value"))
    per_file = pairs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pair", "code", "value"))).alias("pairs"))
    starts = F.filter("pairs", lambda p: p.code == "0")
    spans = F.transform(starts, lambda s, k: F.struct(s.value.alias("kind"), s.pair.alias("a"), F.coalesce(F.try_element_at(starts, k + 2).pair, F.lit(2**30)).alias("b")))
    entity = per_file.select("file", "pairs", F.posexplode(F.filter(spans, lambda e: e.kind == "LINE")).alias("entity_id", "e"))
    own = F.slice("pairs", F.col("e.a").cast("int") + 1, F.least(F.col("e.b") - F.col("e.a"), F.lit(64)).cast("int"))
    value = lambda code: F.try_element_at(F.filter(own, lambda p: p.code == code), F.lit(1)).value
    return entity.select("file", "entity_id", value("8").alias("layer"), *[value(c).cast("double").alias(n) for c, n in (("10", "x1"), ("20", "y1"), ("11", "x2"), ("21", "y2"))])


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(file, assembly, assembly_confidence, shapes, relations, rank, class, confidence, reason) of text reports."""
    lines = _numbered_lines(spark, path).where("trim(value) <> ''")
    find = lambda pattern: F.regexp_extract("value", pattern, 1)
    heads = lines.where("line < 2").groupBy("file").agg(
        F.max(F.when(F.col("line") == 0, find(r"assembly=(\S+)"))).alias("assembly"),
        F.max(F.when(F.col("line") == 0, find(r"conf=(\S+)"))).cast("double").alias("assembly_confidence"),
        F.max(F.when(F.col("line") == 1, find(r"shapes=(\d+)"))).cast("int").alias("shapes"),
        F.max(F.when(F.col("line") == 1, find(r"relations=(\d+)"))).cast("int").alias("relations"),
    )
    return lines.where("line > 1").join(heads, "file").select("file", "assembly", "assembly_confidence", "shapes", "relations", (F.col("line") - 1).alias("rank"), find(r"^(\S+)").alias("class"), find(r"^\S+\s+(\S+)").cast("double").alias("confidence"), find(r"^\S+\s+\S+\s+(.*)$").alias("reason"))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, path, bytes, content) of photos, whose folder is their session."""
    photos = spark.read.format("binaryFile").load(path)
    return photos.select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "path", F.col("length").alias("bytes"), "content")
