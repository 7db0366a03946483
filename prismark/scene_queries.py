"""Queries of cameras, rays, frames, shapes and experience, with SQL that has the same results.

Numeric columns stand in for coordinates, as in `queries`; blocks of rows by their keys stand in for views, tracks and
assemblies, so a block has the same size however large the tables are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import imaging as im
from .functions import vectors as v
from .operators import geometry, motion, segments, sessions
from .plans import pipelines
from .queries import _RAYS, query, rounded, table
from .streaming import live

_TRACKS = _RAYS.replace("l_suppkey AS track_id", "l_orderkey AS track_id, l_linenumber AS view_id, l_partkey").replace("SELECT track_id, ox", "SELECT track_id, view_id, l_partkey, ox")


def _rays(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as rays, orders as tracks."""
    raw = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("view_id"), F.col("l_quantity").cast("double").alias("ox"), (F.col("l_discount") * 100).alias("oy"), (F.col("l_tax") * 100).alias("oz"), (1.0 + F.col("l_linenumber")).alias("a"), (2.0 + F.col("l_orderkey") % 5).alias("b"), (3.0 + F.col("l_partkey") % 3).alias("c"))
    d = v.unit(v.vector("a", "b", "c"))
    return raw.select("track_id", "view_id", "ox", "oy", "oz", *[x.alias(n) for x, n in zip(d, ("dx", "dy", "dz"))])


@query(_TRACKS + """
SELECT p.track_id, round(max(degrees(acos(greatest(-1.0, least(1.0, p.dx*q.dx + p.dy*q.dy + p.dz*q.dz))))), 4) + 0.0 AS parallax FROM u p JOIN u q USING (track_id) GROUP BY 1""")
def track_parallax(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest angle between any two rays of a track (F1)."""
    return rounded(geometry.parallax(_rays(spark, folder)), parallax=4)


@query(_TRACKS + """,
w AS (SELECT p.track_id FROM u p JOIN u q USING (track_id) GROUP BY 1 HAVING max(degrees(acos(greatest(-1.0, least(1.0, p.dx*q.dx + p.dy*q.dy + p.dz*q.dz))))) >= 10)
SELECT track_id, count(*) AS rays FROM u WHERE track_id IN (SELECT track_id FROM w) GROUP BY 1""")
def parallax_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rays of the tracks with at least ten degrees (F1)."""
    return geometry.enough_parallax(_rays(spark, folder), 10.0).groupBy("track_id").agg(F.count("*").alias("rays"))


_TURN = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
_OBSERVED = """
WITH o AS (SELECT l_partkey AS track_id, l_suppkey AS view_id, l_orderkey, l_linenumber, 600.0 + l_quantity AS u, 400.0 + l_linenumber AS v FROM lineitem),
p AS (SELECT s_suppkey AS view_id, s_nationkey::DOUBLE AS ox, (s_suppkey % 9)::DOUBLE AS oy, -5.0 AS oz FROM supplier),
c AS (SELECT *, (u - 640.0) / 900.0 AS a, (v - 480.0) / 800.0 AS b FROM o JOIN p USING (view_id))"""


def _observed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    line, s = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    seen = line.select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("view_id"), (600.0 + F.col("l_quantity")).alias("u"), (400.0 + F.col("l_linenumber")).alias("v"))
    poses = s.select(F.col("s_suppkey").alias("view_id"), F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 9).cast("double"), F.lit(-5.0)).alias("origin"), F.array(*[F.lit(x) for x in _TURN]).alias("rotation"))
    return seen, poses


_K = (900.0, 800.0, 640.0, 480.0)


@query(_OBSERVED + """
SELECT track_id, view_id, count(*) AS n, round(sum(ox), 4) AS ox, round(sum(-b / sqrt(a*a + b*b + 1)), 5) + 0.0 AS dx, round(sum(a / sqrt(a*a + b*b + 1)), 5) + 0.0 AS dy, round(sum(1 / sqrt(a*a + b*b + 1)), 5) AS dz FROM c GROUP BY 1, 2""")
def observation_rays(spark: SparkSession, folder: str) -> DataFrame:
    """Observations as rays in the world (J4, M4, M6): parts are tracks, suppliers views turned by a right angle."""
    rays = geometry.observation_rays(*_observed(spark, folder), _K)
    sums = rays.groupBy("track_id", "view_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("ox", "dx", "dy", "dz")])
    return rounded(sums, ox=4, dx=5, dy=5, dz=5)


@query(_OBSERVED + """,
w AS (SELECT p_partkey AS track_id, p_size::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y, 40.0 AS z FROM part),
e AS (SELECT track_id, sqrt((900.0 * (y - oy) / (z - oz) + 640.0 - u) ** 2 + (800.0 * -(x - ox) / (z - oz) + 480.0 - v) ** 2) AS e FROM c JOIN w USING (track_id))
SELECT track_id, round(avg(e), 4) AS mean_error, round(max(e), 4) AS max_error FROM e GROUP BY 1""")
def reprojection_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and greatest distance of a point from where it was seen."""
    return rounded(geometry.reprojection(_world(spark, folder), _seen(spark, folder), _K), mean_error=4, max_error=4)


def _world(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 11).cast("double").alias("y"), F.lit(40.0).alias("z"))


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    seen, poses = _observed(spark, folder)
    return seen.join(poses, "view_id").select("track_id", "u", "v", "rotation", *[c.alias(n) for n, c in zip(("ox", "oy", "oz"), v.of_array("origin"))])


@query(_OBSERVED + """,
w AS (SELECT p_partkey AS track_id, p_size::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y, 40.0 AS z FROM part),
e AS (SELECT track_id, sqrt((900.0 * (y - oy) / (z - oz) + 640.0 - u) ** 2 + (800.0 * -(x - ox) / (z - oz) + 480.0 - v) ** 2) AS e FROM c JOIN w USING (track_id))
SELECT track_id FROM e GROUP BY 1 HAVING max(e) <= 900""")
def reprojection_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Points that are never seen too far from where they should be (F2)."""
    return geometry.small_reprojection(_world(spark, folder), _seen(spark, folder), _K, 900.0).select("track_id")


_MULTI = """
WITH o AS (SELECT l_orderkey AS track_id, (l_suppkey - 1) % 100 + 1 AS view_id, 600.0 + l_quantity AS u, 400.0 + l_linenumber * 10 AS v FROM lineitem),
p AS (SELECT s_suppkey AS view_id, s_suppkey * 10.0 AS ox, (s_suppkey % 9) * 5.0 AS oy, -5.0 AS oz FROM supplier),
c AS (SELECT *, (u - 640.0) / 900.0 AS a, (v - 480.0) / 800.0 AS b FROM o JOIN p USING (view_id)),
r AS (SELECT track_id, view_id, u, v, ox, oy, oz, a / sqrt(a*a + b*b + 1) AS dx, b / sqrt(a*a + b*b + 1) AS dy, 1 / sqrt(a*a + b*b + 1) AS dz FROM c),
w AS (SELECT x.track_id FROM r x JOIN r y USING (track_id) GROUP BY 1 HAVING max(degrees(acos(greatest(-1.0, least(1.0, x.dx*y.dx + x.dy*y.dy + x.dz*y.dz))))) >= 1),
s AS (SELECT track_id, count(*) AS n, sum(1 - dx*dx) AS m00, sum(-dx*dy) AS m01, sum(-dx*dz) AS m02, sum(1 - dy*dy) AS m11, sum(-dy*dz) AS m12, sum(1 - dz*dz) AS m22,
  sum(ox - dx*(dx*ox + dy*oy + dz*oz)) AS b0, sum(oy - dy*(dx*ox + dy*oy + dz*oz)) AS b1, sum(oz - dz*(dx*ox + dy*oy + dz*oz)) AS b2 FROM r WHERE track_id IN (SELECT track_id FROM w) GROUP BY track_id),
d AS (SELECT *, m00*(m11*m22 - m12*m12) - m01*(m01*m22 - m12*m02) + m02*(m01*m12 - m11*m02) AS det FROM s),
q AS (SELECT track_id, n, (b0*(m11*m22 - m12*m12) - m01*(b1*m22 - m12*b2) + m02*(b1*m12 - m11*b2)) / det AS x, (m00*(b1*m22 - m12*b2) - b0*(m01*m22 - m12*m02) + m02*(m01*b2 - b1*m02)) / det AS y, (m00*(m11*b2 - b1*m12) - m01*(m01*b2 - b1*m02) + b0*(m01*m12 - m11*m02)) / det AS z FROM d),
e AS (SELECT track_id, max(CASE WHEN z - oz > 1e-9 THEN sqrt((900.0 * (x - ox) / (z - oz) + 640.0 - u) ** 2 + (800.0 * (y - oy) / (z - oz) + 480.0 - v) ** 2) ELSE 1e300 END) AS e FROM q JOIN r USING (track_id) GROUP BY 1)
SELECT track_id, n, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y, round(z, 2) + 0.0 AS z FROM q JOIN e USING (track_id) WHERE e <= 5000"""


@query(_MULTI)
def multi_view_points(spark: SparkSession, folder: str) -> DataFrame:
    """The multi-view pipeline (J4, F1, A2, F2, X2): orders stand in for tracks, suppliers for views."""
    line, s = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    seen = line.select(F.col("l_orderkey").alias("track_id"), ((F.col("l_suppkey") - 1) % 100 + 1).alias("view_id"), (600.0 + F.col("l_quantity")).alias("u"), (400.0 + F.col("l_linenumber") * 10).alias("v"))
    poses = s.select(F.col("s_suppkey").alias("view_id"), F.array((F.col("s_suppkey") * 10).cast("double"), (F.col("s_suppkey") % 9 * 5).cast("double"), F.lit(-5.0)).alias("origin"), F.array(*[F.lit(float(x)) for x in "100010001"]).alias("rotation"))
    found = pipelines.multi_view_cloud(seen, poses, _K, least_parallax=1.0, most_pixels=5000.0)
    return rounded(found, x=2, y=2, z=2).select("track_id", "n", "x", "y", "z")


_VPS = """
WITH p AS (SELECT s_suppkey AS view_id, vp, 100.0 * s_nationkey + 900 * vp - 400 AS u, 300.0 + s_suppkey % 50 - 700 * vp AS v, 0.5 - vp / 8.0 AS confidence FROM supplier CROSS JOIN (SELECT unnest([0, 1, 2]) AS vp) WHERE vp <= s_suppkey % 3),
d AS (SELECT *, (u - 640.0) / 900.0 AS a, (v - 480.0) / 800.0 AS b FROM p),
e AS (SELECT view_id, vp, confidence, a / sqrt(a*a + b*b + 1) AS x, b / sqrt(a*a + b*b + 1) AS y, 1 / sqrt(a*a + b*b + 1) AS z FROM d)"""


def _vanishing(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").withColumn("vp", F.explode(F.array(*[F.lit(k) for k in range(3)]))).where("vp <= s_suppkey % 3")
    return s.select(F.col("s_suppkey").alias("view_id"), "vp", (100.0 * F.col("s_nationkey") + 900 * F.col("vp") - 400).alias("u"), (300.0 + F.col("s_suppkey") % 50 - 700 * F.col("vp")).alias("v"), (0.5 - F.col("vp") / 8).alias("confidence"))


@query(_VPS + """,
f AS (SELECT a.view_id, a.x AS xx, a.y AS xy, a.z AS xz, b.x - (b.x*a.x + b.y*a.y + b.z*a.z) * a.x AS wx, b.y - (b.x*a.x + b.y*a.y + b.z*a.z) * a.y AS wy, b.z - (b.x*a.x + b.y*a.y + b.z*a.z) * a.z AS wz FROM e a JOIN e b ON a.view_id = b.view_id AND a.vp = 0 AND b.vp = 1),
g AS (SELECT view_id, xx, xy, xz, -wx / sqrt(wx*wx + wy*wy + wz*wz) AS yx, -wy / sqrt(wx*wx + wy*wy + wz*wz) AS yy, -wz / sqrt(wx*wx + wy*wy + wz*wz) AS yz FROM f)
SELECT view_id, round(xx, 7) + 0.0 AS xx, round(xy, 7) + 0.0 AS xy, round(yx, 7) + 0.0 AS yx, round(yz, 7) + 0.0 AS yz, round(xy*yz - xz*yy, 7) + 0.0 AS zx, round(xx*yy - xy*yx, 7) + 0.0 AS zz FROM g""")
def perspective_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Orthogonal frames from two vanishing points (M3, M5): suppliers stand in for views."""
    f = geometry.perspective_frames(_vanishing(spark, folder), _K).where("size(vanishingPoints) >= 2")
    pick = {"xx": ("xAxis", 1), "xy": ("xAxis", 2), "yx": ("yAxis", 1), "yz": ("yAxis", 3), "zx": ("zAxis", 1), "zz": ("zAxis", 3)}
    return rounded(f.select("view_id", *[F.element_at(a, k).alias(n) for n, (a, k) in pick.items()]), **dict.fromkeys(pick, 7))


@query(_VPS + """,
n AS (SELECT view_id, count(*) AS n, max(confidence) FILTER (vp = 0) AS c1, max(confidence) FILTER (vp = 1) AS c2, max(confidence) FILTER (vp = 2) AS c3 FROM e GROUP BY 1)
SELECT view_id, 'extrusion_axis' AS type, round(0.94967 * c1, 6) AS confidence FROM n UNION ALL SELECT view_id, 'plane', round((c1 + c2) / 2, 6) FROM n WHERE n >= 2 UNION ALL SELECT view_id, 'box', round(least(1.0, (c1 + c2 + c3) / 3 + 0.15), 6) FROM n WHERE n >= 3""")
def perspective_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """An extrusion axis, a plane, a box, by how many vanishing points a view has."""
    f = geometry.perspective_frames(_vanishing(spark, folder), _K).select("view_id", F.explode("geometryCandidates").alias("c"))
    return rounded(f.select("view_id", "c.type", "c.confidence"), confidence=6)


@query("""
WITH f AS (SELECT p_partkey AS view_id, p_partkey // 8 AS session_id, 0.25 + p_size / 100.0 AS w, cos(p_partkey % 7 / 10.0) AS c, sin(p_partkey % 7 / 10.0) AS s, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS g FROM part),
t AS (SELECT session_id, w, -s * g AS x0, c * g AS x1, 0.0 AS x2, -c * g AS y0, -s * g AS y1, 0.5 * g AS y2, view_id FROM f),
o AS (SELECT *, first_value(x0) OVER k AS p0, first_value(x1) OVER k AS p1, first_value(y0) OVER k AS q0, first_value(y1) OVER k AS q1, first_value(y2) OVER k AS q2 FROM t WINDOW k AS (PARTITION BY session_id ORDER BY view_id)),
a AS (SELECT session_id, count(*) AS views, sum(w * sx * x0) AS x0, sum(w * sx * x1) AS x1, sum(w * sy * y0) AS y0, sum(w * sy * y1) AS y1, sum(w * sy * y2) AS y2
  FROM (SELECT *, CASE WHEN x0*p0 + x1*p1 < 0 THEN -1.0 ELSE 1.0 END AS sx, CASE WHEN y0*q0 + y1*q1 + y2*q2 < 0 THEN -1.0 ELSE 1.0 END AS sy FROM o) GROUP BY 1),
u AS (SELECT session_id, views, x0 / sqrt(x0*x0 + x1*x1) AS a0, x1 / sqrt(x0*x0 + x1*x1) AS a1, y0, y1, y2 FROM a),
b AS (SELECT *, y0 - a0 * (a0*y0 + a1*y1) AS b0, y1 - a1 * (a0*y0 + a1*y1) AS b1, y2 AS b2 FROM u)
SELECT session_id, views, round(a0, 6) + 0.0 AS x0, round(a1, 6) + 0.0 AS x1, round(b0 / sqrt(b0*b0 + b1*b1 + b2*b2), 6) + 0.0 AS y0, round(b2 / sqrt(b0*b0 + b1*b1 + b2*b2), 6) + 0.0 AS y2 FROM b""")
def fused_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of several poses as one (J8, A8): parts stand in for views, eight a session; every other one is turned over."""
    p = table(spark, folder, "part")
    t = F.col("p_partkey") % 7 / 10.0
    g = F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(-1.0)
    frames = p.select(F.col("p_partkey").alias("view_id"), F.floor(F.col("p_partkey") / 8).alias("session_id"), (0.25 + F.col("p_size") / 100.0).alias("confidence"), F.array(F.cos(t) * g, F.sin(t) * g, F.lit(0.0)).alias("xAxis"), F.array(-F.sin(t) * g, F.cos(t) * g, 0.5 * g).alias("yAxis"))
    poses = p.select(F.col("p_partkey").alias("view_id"), F.array(*[F.lit(x) for x in _TURN]).alias("rotation"))
    f = geometry.fuse_frames(frames, poses)
    pick = {"x0": ("xAxis", 1), "x1": ("xAxis", 2), "y0": ("yAxis", 1), "y2": ("yAxis", 3)}
    return rounded(f.select("session_id", "views", *[F.element_at(a, k).alias(n) for n, (a, k) in pick.items()]), **dict.fromkeys(pick, 6))


_SHAPES = "WITH s AS (SELECT p_partkey // 16 AS assembly, p_partkey AS shape_id, (p_partkey % 3)::DOUBLE AS x, 0.0 AS y, (p_partkey % 16 * 10)::DOUBLE AS z, 2.0 + p_size % 4 AS radius, 10.0 + p_size % 5 * 10 AS height FROM part)"


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select(F.floor(F.col("p_partkey") / 16).alias("assembly"), F.col("p_partkey").alias("shape_id"), F.lit("cylinder").alias("kind"), (F.col("p_partkey") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("p_partkey") % 16 * 10).cast("double").alias("z"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"), (2.0 + F.col("p_size") % 4).alias("radius"), (10.0 + F.col("p_size") % 5 * 10).alias("height"))


@query(_SHAPES + """,
p AS (SELECT a.assembly, a.shape_id AS a_id, b.shape_id AS b_id, abs(b.x - a.x) AS o, abs(b.z - a.z) AS t, a.radius AS r, b.radius AS q, a.height AS h, b.height AS g FROM s a JOIN s b ON a.assembly = b.assembly AND a.shape_id < b.shape_id)
SELECT assembly, a_id, b_id, 'coaxial' AS relation FROM p WHERE o <= 1 UNION ALL SELECT assembly, a_id, b_id, 'concentric' FROM p WHERE o <= 1 AND sqrt(o*o + t*t) <= 1
UNION ALL SELECT assembly, a_id, b_id, 'contains' FROM p WHERE o <= 1 AND t + least(h, g) / 2 <= greatest(h, g) / 2 + 1 AND (r - q) * (h - g) > 0
UNION ALL SELECT assembly, a_id, b_id, 'supports' FROM p WHERE o <= 1 AND abs(t - (h + g) / 2) <= 1 UNION ALL SELECT assembly, a_id, b_id, 'attached' FROM p WHERE abs(t - (h + g) / 2) <= 1 AND o <= r + q + 1""")
def shape_grammar(spark: SparkSession, folder: str) -> DataFrame:
    """All relations of shapes in assemblies of sixteen (J7, G5): parallel axes, places from the keys."""
    return geometry.shape_relations(_shapes(spark, folder), tolerance=1.0)


@query("""
WITH s AS (SELECT p_partkey // 8 AS assembly, 50 * cos(p_partkey % 8 * pi() / 4) AS x, 50 * sin(p_partkey % 8 * pi() / 4) + CASE WHEN p_size < 5 THEN 20 ELSE 0 END AS y, 3.0 AS z FROM part),
c AS (SELECT assembly, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1), d AS (SELECT assembly, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d FROM s JOIN c USING (assembly))
SELECT assembly, 'bolt' AS kind, count(*) AS count, round(avg(d), 4) AS ring FROM d GROUP BY 1 HAVING count(*) >= 3 AND avg(d) > 5 AND max(d) - min(d) <= 5""")
def radial_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Equal shapes around a centre (J7): eight parts a ring, of which small ones are out of place."""
    at = F.col("p_partkey") % 8 * F.lit(3.141592653589793) / 4
    s = table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 8).alias("assembly"), F.lit("bolt").alias("kind"), (50 * F.cos(at)).alias("x"), (50 * F.sin(at) + F.when(F.col("p_size") < 5, 20).otherwise(0)).alias("y"), F.lit(3.0).alias("z"))
    return rounded(geometry.radial_repetition(s), ring=4)


@query("""
WITH e AS (SELECT event_id AS view_id, event_id % 7 AS lines, user_id % 3 AS ellipses, event_id % 4 AS vps FROM events)
SELECT view_id, 'BOX' AS type, 'Prisma posible' AS label, round(CAST(least(0.95, 0.52 + 0.1 * vps) AS DOUBLE), 6) AS confidence FROM e WHERE vps >= 3 UNION ALL SELECT view_id, 'PLANE', 'Plano posible', round(CAST(least(0.95, 0.42 + 0.1 * vps) AS DOUBLE), 6) FROM e WHERE vps >= 2
UNION ALL SELECT view_id, 'CYLINDER', 'Cilindro posible', round(CAST(least(0.95, 0.5 + 0.1 * ellipses) AS DOUBLE), 6) FROM e WHERE ellipses >= 1 AND lines >= 2""")
def evidence_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes, planes and cylinders from counts of lines, ellipses and vanishing points."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("view_id"), (F.col("event_id") % 7).alias("lines"), (F.col("user_id") % 3).alias("ellipses"), (F.col("event_id") % 4).alias("vps"))
    return rounded(geometry.hypotheses(e), confidence=6)


@query("""
WITH s AS (SELECT p_partkey AS shape_id, CASE p_partkey % 4 WHEN 0 THEN 'pulley' WHEN 1 THEN 'bearing-housing' WHEN 2 THEN ' Rectangular prism ' ELSE p_type END AS name FROM part),
c AS (SELECT shape_id, upper(regexp_replace(trim(name), '[\\s-]+', '_', 'g')) AS class FROM s),
k AS (SELECT shape_id, CASE WHEN class IN ('PULLEY', 'BEARING_HOUSING', 'RECTANGULAR_PRISM') THEN class END AS class FROM c),
d AS (SELECT shape_id, class, CASE class WHEN 'PULLEY' THEN ['CYLINDER', 'SHAFT', 'DISC', 'DISC', 'ANNULUS', 'BOLT_PATTERN'] WHEN 'BEARING_HOUSING' THEN ['ARCHED_HOUSING', 'ANNULUS', 'HOLE', 'RECTANGULAR_PRISM'] ELSE [class] END AS parts FROM k)
SELECT shape_id, class, unnest(parts) AS part, unnest(range(len(parts)))::INTEGER AS part_no FROM d""")
def part_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the vocabulary's spelling, compound parts as their parts (G4, G6); other names are null."""
    kind = F.col("p_partkey") % 4
    s = table(spark, folder, "part").select(F.col("p_partkey").alias("shape_id"), F.when(kind == 0, "pulley").when(kind == 1, "bearing-housing").when(kind == 2, " Rectangular prism ").otherwise(F.col("p_type")).alias("name"))
    return geometry.decompose(s.select("shape_id", geometry.canonical_class("name").alias("class"))).select("shape_id", "class", "part", "part_no")


@query("""
WITH b AS (SELECT l_orderkey AS view_id, l_linenumber AS x1, 0 AS y1, l_linenumber + 1 + l_suppkey % 5 AS x2, 3 + l_partkey % 4 AS y2, 0.5 + l_discount AS fill FROM lineitem),
w AS (SELECT view_id, max({'area': (x2 - x1) * (y2 - y1), 'fill': fill, 'w': x2 - x1, 'h': y2 - y1}) AS b FROM b GROUP BY 1)
SELECT view_id, 'BOX' AS type, CASE WHEN greatest(b.w, b.h) / least(b.w, b.h)::DOUBLE < 1.1 THEN 'Base cuadrada propuesta' ELSE 'Base rectangular propuesta' END AS label, round(least(0.95, b.fill), 6) AS "visualConfidence" FROM w""")
def base_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """The largest region of a view as its base (M20): line items stand in for regions, orders for views."""
    b = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("view_id"), F.col("l_linenumber").alias("x1"), F.lit(0).alias("y1"), (F.col("l_linenumber") + 1 + F.col("l_suppkey") % 5).alias("x2"), (3 + F.col("l_partkey") % 4).alias("y2"), (0.5 + F.col("l_discount")).alias("fill"))
    return rounded(geometry.base_proposal(b), visualConfidence=6)


@query("""
WITH c AS (SELECT l_orderkey // 8 AS view_id, l_orderkey AS r, l_linenumber AS c FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT *, (r * 7 + c * c * 3) % 11 AS g FROM c),
k(dr, dc, wx, wy) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1))
SELECT view_id, r - dr AS r, c - dc AS c, sum(g * wx)::DOUBLE AS gx, sum(g * wy)::DOUBLE AS gy, round(sqrt((sum(g * wx) ** 2 + sum(g * wy) ** 2)::DOUBLE), 6) AS magnitude FROM p CROSS JOIN k GROUP BY 1, 2, 3 HAVING count(*) = 8""")
def sobel_gradients(spark: SparkSession, folder: str) -> DataFrame:
    """Sobel gradients of pixels with all neighbours (W3): orders are rows, eight a view, line numbers columns."""
    cells = table(spark, folder, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("view_id"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c")).distinct()
    return rounded(segments.sobel(cells.withColumn("g", ((F.col("r") * 7 + F.col("c") * F.col("c") * 3) % 11).cast("double"))), magnitude=6)


@query("""
SELECT event_id AS frame_id, user_id AS session_id, previous FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous IS NOT NULL""")
def consecutive_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame with the one before it (X3): users stand in for sessions."""
    return motion.frame_pairs(table(spark, folder, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("session_id")))


@query("SELECT user_id AS session_id, max(event_id) AS frame_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's newest frame of a batch."""
    return live.keep_latest(table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_id"), "value"))


@query("""
SELECT 'ai' AS origin, p_partkey AS part_id, 'BOX' AS type, p_size / 100.0 AS confidence, NULL AS meaning FROM part UNION ALL SELECT 'manual', s_suppkey, 'LINE', NULL, s_name FROM supplier""")
def hypotheses_and_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Machine hypotheses and manual constraints side by side."""
    ai = table(spark, folder, "part").select(F.col("p_partkey").alias("part_id"), F.lit("BOX").alias("type"), (F.col("p_size") / 100.0).alias("confidence"))
    manual = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("part_id"), F.lit("LINE").alias("type"), F.col("s_name").alias("meaning"))
    return sessions.keep_both(ai, manual).select("origin", "part_id", "type", "confidence", "meaning")


@query("""
WITH j AS (SELECT o_orderkey AS session_id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey / 8.0 END AS scale, o_orderstatus = 'O' AS accepted FROM orders)
SELECT session_id, CASE WHEN scale IS NOT NULL THEN 'calibrated' WHEN accepted THEN 'accepted' ELSE 'visual_hypothesis' END AS state, round(10 * scale, 6) AS "lengthMm", round(20 * scale, 6) AS "widthMm", CAST(CASE WHEN scale IS NULL THEN 0.71 ELSE 0.96 END AS DOUBLE) AS confidence FROM j""")
def refined_models(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals in millimetres once there is a scale, and the model's state (F9, M17, A14): orders stand in for sessions."""
    o = table(spark, folder, "orders")
    proposals = o.select(F.col("o_orderkey").alias("session_id"), F.lit(0.71).alias("visualConfidence"), F.lit(10.0).alias("length_px"), F.lit(20.0).alias("width_px"), F.lit(5.0).alias("height_px"))
    scales = o.where("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") / 8.0).alias("scale"), F.lit(1).alias("n"))
    m = sessions.refine_model(proposals, scales).join(o.select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "O").alias("accepted")), "session_id")
    return rounded(m.select("session_id", sessions.model_state(F.col("metricCalibrated"), F.col("accepted")).alias("state"), "lengthMm", "widthMm", "confidence"), lengthMm=6, widthMm=6, confidence=6)


@query("""
WITH r AS (SELECT source AS class, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS predicted FROM documents WHERE n_chars % 100 >= 65 AND doc_id % 7 > 0),
p AS (SELECT class, (count_if(predicted = class) + 4.0) / (count(*) + 8.0) AS reliability FROM r GROUP BY 1),
d AS (SELECT doc_id // 16 AS session_id, doc_id, source AS class, (doc_id % 90) / 100.0 AS confidence, coalesce(reliability, 0.5) AS w FROM documents LEFT JOIN p ON source = p.class),
a AS (SELECT *, greatest(0.0, least(0.999, confidence + greatest(-0.12, least(0.12, 0.4 * (w - 0.5))))) AS adjusted FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY adjusted DESC, class) AS n FROM a)
SELECT session_id, count(*) AS n, round(min(adjusted), 6) AS least, round(sum(adjusted), 5) AS total FROM k WHERE n <= 8 GROUP BY 1""")
def personalised_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The best eight detections of a session after learning from confirmed records."""
    d = table(spark, folder, "documents")
    records = d.select(F.col("source").alias("class"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.col("source")).alias("predicted"), ((F.col("n_chars") % 100) / 100).alias("quality"), (F.col("doc_id") % 7 > 0).alias("confirmed"))
    found = d.select(F.floor(F.col("doc_id") / 16).alias("session_id"), F.col("source").alias("class"), ((F.col("doc_id") % 90) / 100).alias("confidence"))
    best = pipelines.personalised(found, records).groupBy("session_id").agg(F.count("*").alias("n"), F.min("adjusted").alias("least"), F.sum("adjusted").alias("total"))
    return rounded(best, least=6, total=5)


@query("""
SELECT p_partkey AS part_id, CASE WHEN r < 1.15 THEN 'sphere' WHEN r < 1.8 THEN 'box' WHEN r < 4 THEN 'cylinder' ELSE 'cone' END AS shape, round(least(0.95, 0.5 + (p_partkey % 100) / 200.0), 6) AS confidence, (2400.0 - p_size) / 2 AS base
FROM (SELECT *, greatest(p_size, 10) / least(p_size, 10)::DOUBLE AS r FROM part)""")
def shape_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes by proportions, and where a centred part begins."""
    kind, confidence = im.shape_estimate("p_size", F.lit(10), F.col("p_partkey") % 100 / 100.0)
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("part_id"), kind.alias("shape"), confidence.alias("confidence"), im.centred_base("p_size", 2400.0).alias("base"))
    return rounded(p, confidence=6)


@query("""
WITH q AS (SELECT event_id, 1.0 AS w, value / 100 AS x, user_id % 10 / 10.0 AS y, 0.25 AS z FROM events), s AS (SELECT *, 2.0 / (w*w + x*x + y*y + z*z) AS s FROM q),
r AS (SELECT event_id, w, x, y, z, 1 - s*(y*y + z*z) AS r0, s*(x*y - w*z) AS r1, s*(x*z + w*y) AS r2, s*(x*y + w*z) AS r3, 1 - s*(x*x + z*z) AS r4, s*(y*z - w*x) AS r5, s*(x*z - w*y) AS r6, s*(y*z + w*x) AS r7, 1 - s*(x*x + y*y) AS r8 FROM s)
SELECT event_id, round(r0, 7) + 0.0 AS r0, round(r5, 7) + 0.0 AS r5, round(r0*(r4*r8 - r5*r7) - r1*(r3*r8 - r5*r6) + r2*(r3*r7 - r4*r6), 6) AS determinant, round(x / sqrt(w*w + x*x + y*y + z*z), 6) + 0.0 AS qx, round(sqrt(x*x + y*y + z*z), 6) AS length FROM r""")
def rotations(spark: SparkSession, folder: str) -> DataFrame:
    """Quaternions to rotations and back (M1, M2, M3), and the length of a translation."""
    e = table(spark, folder, "events")
    q = (F.lit(1.0), F.col("value") / 100, F.col("user_id") % 10 / 10.0, F.lit(0.25))
    r = v.quaternion_to_matrix(*q)
    named = e.select("event_id", *[x.alias(f"q{k}") for k, x in enumerate(q)], *[x.alias(f"m{k}") for k, x in enumerate(r)])
    m = tuple(F.col(f"m{k}") for k in range(9))
    back = v.matrix_to_quaternion(m)
    return rounded(named.select("event_id", F.col("m0").alias("r0"), F.col("m5").alias("r5"), v.determinant(m).alias("determinant"), back[1].alias("qx"), im.translation_mm("q1", "q2", "q3").alias("length")), r0=7, r5=7, determinant=6, qx=6, length=6)


@query("""
WITH i AS (SELECT event_id, value / 100 AS a, value / 200 AS b FROM events),
h AS (SELECT event_id, tanh(0.2 * a - 0.1 * 0.1 + 0.1 * 0.9) AS h1, tanh(0.2 * b + 0.1 * 0.1 - 0.1 * 0.9) AS h2, tanh(0.1 * a - 0.1 * b + 0.2 * 0.1 + 0.2 * 0.9 + 0.1) AS h3 FROM i)
SELECT event_id, round(0.05 * h1 + 0.05 * h2 + 0.05 * h3 + 1, 7) AS scale, round(greatest(0.0, least(1.0, 0.1 * h1 + 0.1 * h2 + 0.3 * h3 + 0.5)), 7) AS confidence FROM h""")
def mlp_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The motion network with its seed weights (L1)."""
    scale, confidence = motion.motion_model([F.col("value") / 100, F.col("value") / 200, F.lit(0.1), F.lit(0.9)])
    return rounded(table(spark, folder, "events").select("event_id", scale.alias("scale"), confidence.alias("confidence")), scale=7, confidence=7)


@query("""
WITH f AS (SELECT user_id AS session_id, count(*) AS matches, avg(value) AS du, max(value) / 3 AS dv, count_if(value <= 30) AS inliers, sum(value) / 1e5 AS gx, min(value) / 100 AS gy, count(*) / 1000.0 AS az FROM events GROUP BY 1),
s AS (SELECT *, inliers / matches::DOUBLE AS share, sqrt(gx*gx + gy*gy) AS angle, du / 100 AS a, dv / 100 AS b FROM f),
h AS (SELECT *, tanh(0.2 * a - 0.1 * 0.5 + 0.1 * share) AS h1, tanh(0.2 * b + 0.1 * 0.5 - 0.1 * share) AS h2, tanh(0.1 * a - 0.1 * b + 0.2 * 0.5 + 0.2 * share + 0.1) AS h3 FROM s)
SELECT session_id, round(-du * 0.5 * (0.05 * (h1 + h2 + h3) + 1), 5) + 0.0 AS tx, round(az * 2.0 / 2 * 1000, 5) + 0.0 AS tz, round(cos(angle / 2), 7) AS qw, round(gx * CASE WHEN angle > 1e-12 THEN sin(angle / 2) / angle ELSE 0.5 END, 7) + 0.0 AS qx, round(greatest(0.0, least(1.0, 0.1 * h1 + 0.1 * h2 + 0.3 * h3 + 0.5)) * share, 6) AS confidence FROM h""")
def relative_motions(spark: SparkSession, folder: str) -> DataFrame:
    """Visual and inertial parts of a motion as one (L2, L7): users stand in for sessions of one frame."""
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("session_id"))
    stats = e.agg(F.count("*").alias("matches"), F.avg("value").alias("du"), (F.max("value") / 3).alias("dv"), F.count_if(F.col("value") <= 30).alias("inliers"), F.lit(5.0).alias("dispersion"))
    inertial = e.agg((F.sum("value") / 1e5).alias("int_gx"), (F.min("value") / 100).alias("int_gy"), F.lit(0.0).alias("int_gz"), (F.count("*") / 1000.0).alias("int_az"), F.lit(2.0).alias("seconds"))
    m = motion.relative_motion(stats, inertial, 0.5, keys=("session_id",))
    return rounded(m.select("session_id", "tx", "tz", "qw", "qx", "confidence"), tx=5, tz=5, qw=7, qx=7, confidence=6)


@query("""
WITH l AS (SELECT vec_id // 64 AS pair_id, vec_id AS feat_id, embedding AS d, 500.0 + vec_id % 32 AS u, (vec_id % 3)::DOUBLE AS v FROM embeddings),
a AS (SELECT pair_id, feat_id AS a_id, d AS p, u AS u1, v AS v1 FROM l WHERE feat_id % 2 = 0), b AS (SELECT pair_id, feat_id AS b_id, d AS q, u / 2 AS u2, v AS v2 FROM l WHERE feat_id % 2 = 1),
m AS (SELECT *, sqrt(list_sum(list_transform(list_zip(p, q), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))) AS d FROM a JOIN b USING (pair_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY pair_id, b_id ORDER BY d, a_id) AS rb FROM m)
SELECT pair_id, a_id, b_id, round((u1 - 320.0) * 120.0 / (u1 - u2), 4) + 0.0 AS x, round(800.0 * 120.0 / (u1 - u2), 4) AS z FROM r WHERE ra = 1 AND rb = 1 AND abs(v1 - v2) <= 1.5 AND u1 > u2""")
def stereo_points(spark: SparkSession, folder: str) -> DataFrame:
    """The stereo service (L7, J1, A3): even and odd vectors are the two views, 64 a pair."""
    e = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("pair_id"), F.col("vec_id").alias("feat_id"), (500.0 + F.col("vec_id") % 32).alias("u"), (F.col("vec_id") % 3).cast("double").alias("v"), F.col("embedding").alias("desc"))
    cloud = pipelines.stereo_cloud(e.where("feat_id % 2 = 0"), e.where("feat_id % 2 = 1").withColumn("u", F.col("u") / 2), 800.0, 120.0, 320.0, 240.0)
    return rounded(cloud.select("pair_id", "a_id", "b_id", "x", "z"), x=4, z=4)
