"""Queries of the geometric operators over the driver's tables, with SQL that has the same results.

The tables hold no photos or geometry, so numeric columns stand in for coordinates: the queries test what an operator
computes, not photogrammetry. Doubles are rounded on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import imaging as im
from .functions import vectors as v
from .operators import geometry, graphs, motion, segments, sessions
from .sources import sinks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, **decimals: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in decimals.items()})


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as points: quantity, discount in percent, tax in percent; the supplier stands in for a cloud or view."""
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("view_id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


@query("""
WITH cells AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS c FROM lineitem),
islands AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS island FROM cells)
SELECT r, min(c) AS x1, max(c) AS x2 FROM islands GROUP BY r, island HAVING max(c) - min(c) >= 3""")
def runlength_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Run-length vectorization (W1, F6): orders stand in for rows of an image, line numbers for edge cells."""
    cells = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"))
    return segments.runs(cells, 3, keys=("r",))


@query("""
WITH steps AS (SELECT user_id, ts, event_id, value AS dx, value / 2 AS dy, value / 100 AS dt FROM events),
headed AS (SELECT *, coalesce(sum(dt) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM steps)
SELECT user_id, event_id, round(sum(dx * cos(t) - dy * sin(t)) OVER w, 4) + 0.0 AS x, round(sum(dx * sin(t) + dy * cos(t)) OVER w, 4) + 0.0 AS y
FROM headed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def pose_prefix_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Planar pose accumulation (W2): users stand in for sessions, events for steps."""
    steps = table(spark, folder, "events").select("user_id", "ts", "event_id", F.col("value").alias("dx"), (F.col("value") / 2).alias("dy"), (F.col("value") / 100).alias("dtheta"))
    poses = motion.planar_poses(steps, ("user_id",), ("ts", "event_id"))
    return rounded(poses, x=4, y=4).select("user_id", "event_id", "x", "y")


_STEPS = ", ".join(f"({k}, {round(math.cos(k * math.pi / 18), 12)}, {round(math.sin(k * math.pi / 18), 12)})" for k in range(18))


@query(f"""
WITH steps(theta, c, s) AS (VALUES {_STEPS}),
votes AS (SELECT theta, CAST(floor((CAST(l_quantity AS DOUBLE) * c + l_discount * 100 * s) / 10.0 + 1e-9) AS BIGINT) AS rho_bin, count(*) AS votes
  FROM lineitem CROSS JOIN steps GROUP BY 1, 2)
SELECT theta, rho_bin, votes FROM votes ORDER BY votes DESC, theta, rho_bin LIMIT 8""")
def hough_votes_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Hough accumulator and its dominant cells (A4, T3) over line items as points; the eight best are the feature."""
    return segments.dominant_lines(_points(spark, folder), 8, x="x", y="y", keys=())


@query(f"""
WITH steps(theta, c, s) AS (VALUES {_STEPS})
SELECT theta, CAST(floor((CAST(l_quantity AS DOUBLE) * c + l_discount * 100 * s) / 10.0 + 1e-9) AS BIGINT) AS rho_bin, count(*) AS votes
FROM lineitem CROSS JOIN steps GROUP BY 1, 2""")
def hough_votes(spark: SparkSession, folder: str) -> DataFrame:
    """The whole accumulator (A4)."""
    return segments.hough_votes(_points(spark, folder), x="x", y="y", keys=())


@query("""
WITH p AS (SELECT l_suppkey AS view_id, l_quantity AS x, l_discount * 100 AS y FROM lineitem),
h AS (SELECT s_suppkey AS view_id, s_suppkey % 50 AS u, s_nationkey % 10 AS w FROM supplier)
SELECT p.view_id, count(*) AS n, count_if(abs(x - u) + abs(y - w) < 12) AS inliers
FROM p JOIN h USING (view_id) GROUP BY p.view_id""")
def consensus_inliers(spark: SparkSession, folder: str) -> DataFrame:
    """Consensus count (A5, J5): each supplier's hypothesis against the line items of its view, by an equality key."""
    h = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("view_id"), (F.col("s_suppkey") % 50).alias("u"), (F.col("s_nationkey") % 10).alias("w"))
    near = F.abs(F.col("x") - F.col("u")) + F.abs(F.col("y") - F.col("w")) < 12
    return _points(spark, folder).join(h, "view_id").groupBy("view_id").agg(F.count("*").alias("n"), F.count_if(near).alias("inliers"))


@query("""
SELECT l_suppkey AS view_id, count(*) AS n, round(avg(x), 6) + 0.0 AS mean_x, round(avg(y), 6) + 0.0 AS mean_y, round(avg(z), 6) + 0.0 AS mean_z,
  round(var_pop(x), 6) + 0.0 AS cov_xx, round(covar_pop(x, y), 6) + 0.0 AS cov_xy, round(covar_pop(x, z), 6) + 0.0 AS cov_xz,
  round(var_pop(y), 6) + 0.0 AS cov_yy, round(covar_pop(y, z), 6) + 0.0 AS cov_yz, round(var_pop(z), 6) + 0.0 AS cov_zz
FROM (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem) GROUP BY 1""")
def cloud_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments of clouds (A7): one pass, partial sums."""
    m = geometry.moments(_points(spark, folder), ("view_id",))
    return rounded(m, **{c: 6 for c in m.columns if c not in ("view_id", "n")})


@query("""
WITH m AS (SELECT l_suppkey AS view_id, count(*) AS n, avg(x) AS ax, avg(y) AS ay, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy
  FROM (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y FROM lineitem) GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT *, (sxx + syy) / 2 AS h, sqrt(((sxx - syy) / 2) * ((sxx - syy) / 2) + sxy * sxy) AS r FROM m)
SELECT view_id, n, round(ax, 6) AS cx, round(ay, 6) AS cy, round(sqrt(2 * (h + r)), 5) AS major, round(sqrt(2 * greatest(0.0, h - r)), 5) AS minor FROM e""")
def ellipse_by_component(spark: SparkSession, folder: str) -> DataFrame:
    """Ellipses by covariance (A12), suppliers standing in for components."""
    e = segments.ellipses(_points(spark, folder), ("view_id",), x="x", y="y")
    return rounded(e, cx=6, cy=6, major=5, minor=5).select("view_id", "n", "cx", "cy", "major", "minor")


@query("""
WITH r AS (SELECT d.source AS class, l.quality = 1 AS ok FROM labels l JOIN documents d USING (doc_id) WHERE d.n_chars >= 100)
SELECT class, count(*) AS n, round((sum(CAST(ok AS INTEGER)) + 4.0) / (count(*) + 8.0), 9) AS reliability FROM r GROUP BY class""")
def reliability_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """Gate and smoothed reliability (F3, A15): sources stand in for classes, long texts for confirmed sessions."""
    docs = table(spark, folder, "documents").where("n_chars >= 100").select("doc_id", F.col("source").alias("class"))
    rows = table(spark, folder, "labels").join(docs, "doc_id").select("class", (F.col("quality") == 1).alias("ok"))
    return rounded(sessions.reliability(rows), reliability=9)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS s FROM events),
f AS (SELECT user_id, event_id AS frame_id, s - 1800 AS t0, s AS t1 FROM e WHERE event_id % 2 = 0)
SELECT f.user_id, f.frame_id, count(*) AS samples, CAST(sum(e.event_id) AS BIGINT) AS id_sum
FROM e JOIN f ON e.user_id = f.user_id AND e.event_id % 2 = 1 AND e.s >= f.t0 AND e.s <= f.t1 GROUP BY 1, 2""")
def interval_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Samples within frames' windows (J6, X4): odd events against the half hour before even ones, by buckets of time."""
    e = table(spark, folder, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    frames = e.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("frame_id"), (F.col("s") - 1800).alias("t0"), F.col("s").alias("t1"))
    both = graphs.interval_join(e.where("event_id % 2 = 1"), frames, ("user_id",), ts="s", width=1800.0)
    return both.groupBy("user_id", "frame_id").agg(F.count("*").alias("samples"), F.sum("event_id").alias("id_sum"))


@query("""
WITH a AS (SELECT vec_id // 128 AS label, vec_id AS a_id, embedding AS p FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id // 128 AS label, vec_id AS b_id, embedding AS q FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT label, a_id, b_id, sqrt(list_sum(list_transform(list_zip(p, q), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))) AS distance FROM a JOIN b USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, a_id ORDER BY distance, b_id) AS ra, row_number() OVER (PARTITION BY label, b_id ORDER BY distance, a_id) AS rb FROM d)
SELECT label AS pair_id, a_id, b_id, round(distance, 6) AS distance FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nn(spark: SparkSession, folder: str) -> DataFrame:
    """Two-view matching (J1): even and odd vectors stand in for two views, 128 of them for a pair of views."""
    e = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 128).alias("pair_id"), F.col("vec_id").alias("feat_id"), F.col("embedding").alias("desc"))
    return rounded(graphs.match_views(e.where("feat_id % 2 = 0"), e.where("feat_id % 2 = 1")), distance=6)


_RAYS = """
WITH r AS (SELECT l_suppkey AS track_id, CAST(l_quantity AS DOUBLE) AS ox, l_discount * 100 AS oy, l_tax * 100 AS oz, 1.0 + l_linenumber AS a, 2.0 + l_orderkey % 5 AS b, 3.0 + l_partkey % 3 AS c FROM lineitem),
u AS (SELECT track_id, ox, oy, oz, a / sqrt(a*a + b*b + c*c) AS dx, b / sqrt(a*a + b*b + c*c) AS dy, c / sqrt(a*a + b*b + c*c) AS dz FROM r)"""


@query(_RAYS + """,
s AS (SELECT track_id, count(*) AS n, sum(1 - dx*dx) AS m00, sum(-dx*dy) AS m01, sum(-dx*dz) AS m02, sum(1 - dy*dy) AS m11, sum(-dy*dz) AS m12, sum(1 - dz*dz) AS m22,
  sum(ox - dx*(dx*ox + dy*oy + dz*oz)) AS b0, sum(oy - dy*(dx*ox + dy*oy + dz*oz)) AS b1, sum(oz - dz*(dx*ox + dy*oy + dz*oz)) AS b2 FROM u GROUP BY track_id),
d AS (SELECT *, m00*(m11*m22 - m12*m12) - m01*(m01*m22 - m12*m02) + m02*(m01*m12 - m11*m02) AS det FROM s)
SELECT track_id, n, round((b0*(m11*m22 - m12*m12) - m01*(b1*m22 - m12*b2) + m02*(b1*m12 - m11*b2)) / det, 4) + 0.0 AS x,
  round((m00*(b1*m22 - m12*b2) - b0*(m01*m22 - m12*m02) + m02*(m01*b2 - b1*m02)) / det, 4) + 0.0 AS y,
  round((m00*(m11*b2 - b1*m12) - m01*(m01*b2 - b1*m02) + b0*(m01*m12 - m11*m02)) / det, 4) + 0.0 AS z FROM d""")
def ray_intersection(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-ray triangulation (A2): rays derived from line items, suppliers standing in for tracks."""
    raw = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("track_id"), F.col("l_quantity").cast("double").alias("ox"), (F.col("l_discount") * 100).alias("oy"), (F.col("l_tax") * 100).alias("oz"), (1.0 + F.col("l_linenumber")).alias("a"), (2.0 + F.col("l_orderkey") % 5).alias("b"), (3.0 + F.col("l_partkey") % 3).alias("c"))
    d = v.unit(v.vector("a", "b", "c"))
    rays = raw.select("track_id", "ox", "oy", "oz", *[x.alias(n) for x, n in zip(d, ("dx", "dy", "dz"))])
    return rounded(geometry.intersect_rays(rays), x=4, y=4, z=4)


@query("""
WITH RECURSIVE links AS (SELECT DISTINCT event_id AS a, event_id // 16 * 16 + (event_id * 5 + user_id % 3) % 16 AS b FROM events),
sides AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, root) AS (SELECT DISTINCT a, a FROM sides UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.node WHERE sides.b > reach.root)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def tracks_components(spark: SparkSession, folder: str) -> DataFrame:
    """Track construction (J2): full closure of links derived from all events, by least node; links to oneself say nothing."""
    at = F.col("event_id")
    links = table(spark, folder, "events").select(at.alias("a"), (F.floor(at / 16) * 16 + (at * 5 + F.col("user_id") % 3) % 16).alias("b"))
    return graphs.connected(links)


@query("""
WITH s AS (SELECT l_suppkey AS view_id, CAST(l_quantity AS DOUBLE) AS x1, l_discount * 100 AS y1, l_quantity + 1.0 + l_linenumber AS x2, l_discount * 100 + 2.0 + l_orderkey % 5 AS y2 FROM lineitem),
h AS (SELECT view_id, y1 - y2 AS a, x2 - x1 AS b, x1 * y2 - y1 * x2 AS c FROM s),
l AS (SELECT view_id, a / sqrt(a*a + b*b) AS la, b / sqrt(a*a + b*b) AS lb, c / sqrt(a*a + b*b) AS lc FROM h),
q AS (SELECT view_id, count(*) AS inliers, sum(la*la) AS aa, sum(la*lb) AS ab, sum(lb*lb) AS bb, sum(la*lc) AS ac, sum(lb*lc) AS bc FROM l GROUP BY view_id)
SELECT view_id, round((ab*bc - bb*ac) / (aa*bb - ab*ab), 4) + 0.0 AS u, round((ab*ac - aa*bc) / (aa*bb - ab*ab), 4) + 0.0 AS v, inliers FROM q""")
def vp_refine_lsq(spark: SparkSession, folder: str) -> DataFrame:
    """Least-squares vanishing point (M15, A6) of lines derived from line items, one per supplier."""
    s = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("view_id"), F.col("l_quantity").cast("double").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 1.0 + F.col("l_linenumber")).alias("x2"), (F.col("l_discount") * 100 + 2.0 + F.col("l_orderkey") % 5).alias("y2"))
    return rounded(geometry.refine_points(geometry.segment_lines(s)), u=4, v=4)


@query("SELECT event_id AS frame_id, user_id AS session_id FROM events WHERE event_id % 6 = 0")
def frame_stride(spark: SparkSession, folder: str) -> DataFrame:
    """Every sixth frame."""
    return motion.stride(table(spark, folder, "events").select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("session_id")))


@query("""
WITH p AS (SELECT d.source AS class, (sum(l.quality) + 4.0) / (count(*) + 8.0) AS reliability FROM labels l JOIN documents d USING (doc_id) GROUP BY 1),
r AS (SELECT d.doc_id, d.lang AS session_id, d.source AS class, (d.doc_id % 90) / 100.0 AS confidence, p.reliability FROM documents d LEFT JOIN p ON d.source = p.class),
a AS (SELECT *, greatest(0.0, least(0.999, confidence + greatest(-0.12, least(0.12, 0.4 * (coalesce(reliability, 0.5) - 0.5))))) AS adjusted FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(adjusted, 9) DESC, doc_id) AS place FROM a)
SELECT session_id, doc_id, class, round(confidence, 6) AS confidence, round(adjusted, 6) AS adjusted FROM k WHERE place <= 8""")
def bounded_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded experience adjustment, then the best eight (M11, T1, T2): sources are classes, languages sessions."""
    docs = table(spark, folder, "documents")
    rows = table(spark, folder, "labels").join(docs.select("doc_id", F.col("source").alias("class")), "doc_id").select("class", (F.col("quality") == 1).alias("ok"))
    found = docs.select("doc_id", F.col("lang").alias("session_id"), F.col("source").alias("class"), ((F.col("doc_id") % 90) / 100.0).alias("confidence"))
    ranked = rounded(sessions.rerank(found, sessions.reliability(rows)), adjusted=9)
    return rounded(segments.top_k(ranked, [F.desc("adjusted"), "doc_id"], 8, ("session_id",)), confidence=6, adjusted=6).select("session_id", "doc_id", "class", "confidence", "adjusted")


@query("""
WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(n_chars % 2 AS INTEGER) END AS predicted FROM documents),
b AS (SELECT doc_id, quality AS confirmed FROM labels)
SELECT doc_id, predicted, confirmed, CASE WHEN predicted IS NULL THEN 'added' WHEN confirmed IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b USING (doc_id) WHERE predicted IS DISTINCT FROM confirmed""")
def correction_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction against confirmation (J10), null-safe: documents of other languages have none."""
    a = table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") == "en", (F.col("n_chars") % 2).cast("int")).alias("label"))
    b = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return graphs.corrections(a, b, "doc_id", "label")


@query("""
WITH s AS (SELECT p_partkey // 32 AS assembly, p_partkey AS shape_id, p_type AS kind, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS z FROM part)
SELECT a.assembly, a.shape_id AS a_id, b.shape_id AS b_id FROM s a JOIN s b ON a.assembly = b.assembly AND a.shape_id < b.shape_id AND abs(a.x - b.x) <= 1.0""")
def coaxial_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Coaxial shapes (J7): 32 parts an assembly, sizes stand in for the axis's place."""
    p = table(spark, folder, "part")
    shapes = p.select(F.floor(F.col("p_partkey") / 32).alias("assembly"), F.col("p_partkey").alias("shape_id"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("p_retailprice") / 100).alias("z"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"), F.lit(1.0).alias("radius"), F.lit(1.0).alias("height"))
    return geometry.shape_relations(shapes, tolerance=1.0).where("relation = 'coaxial'").drop("relation")


@query("""
SELECT user_id AS device_id, count(DISTINCT CAST(ts AS DATE)) AS sessions, count_if(value > 20) AS confirmed, count_if(value > 20 AND event_type IS DISTINCT FROM 'click') AS corrections,
  round(avg(value / 100), 6) AS mean_quality, round(100 * (1 - exp(-count_if(value > 20) / 50.0)) * avg(value / 100), 6) AS maturity FROM events GROUP BY 1""")
def passport(spark: SparkSession, folder: str) -> DataFrame:
    """Experience roll-up (A16): users stand in for devices, days for sessions."""
    e = table(spark, folder, "events")
    records = e.select(F.col("user_id").alias("device_id"), F.to_date("ts").alias("session_id"), (F.col("value") > 20).alias("confirmed"), F.lit("click").alias("predicted"), F.col("event_type").alias("class"), (F.col("value") / 100).alias("quality"))
    return rounded(sessions.passport(records), mean_quality=6, maturity=6)


@query("""
WITH f AS (SELECT user_id AS session_id, value AS du, value / 3 + event_id % 7 AS dv FROM events),
m AS (SELECT session_id, median(du) AS mu, median(dv) AS mv FROM f GROUP BY 1),
d AS (SELECT session_id, mu, mv, sqrt((du - mu) * (du - mu) + (dv - mv) * (dv - mv)) AS d FROM f JOIN m USING (session_id))
SELECT session_id, round(any_value(mu), 6) AS du, round(any_value(mv), 6) AS dv, round(median(d), 6) AS dispersion, count(*) AS matches, count_if(d <= 30) AS inliers FROM d GROUP BY 1""")
def flow_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Median flow, dispersion, matches and inliers."""
    flow = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("value").alias("du"), (F.col("value") / 3 + F.col("event_id") % 7).alias("dv"))
    return rounded(motion.flow_statistics(flow, 30.0, ("session_id",)), du=6, dv=6, dispersion=6)


@query("""
WITH e AS (SELECT user_id AS session_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS s, event_id, value AS g FROM events),
w AS (SELECT session_id, s - lag(s) OVER o AS dt, (g + lag(g) OVER o) / 2 * (s - lag(s) OVER o) AS area FROM e WINDOW o AS (PARTITION BY session_id ORDER BY s))
SELECT session_id, round(coalesce(sum(dt), 0), 3) AS seconds, round(coalesce(sum(area), 0) / 1000, 3) AS kilo FROM w GROUP BY 1""")
def inertial_window(spark: SparkSession, folder: str) -> DataFrame:
    """Integral of samples over time."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), F.col("value").alias("g"))
    w = motion.inertial_window(e, ("session_id",), ("g",), "s")
    return rounded(w.withColumn("kilo", F.col("int_g") / 1000), seconds=3, kilo=3).select("session_id", "seconds", "kilo")


@query("""
SELECT s_suppkey AS segment_id, round(600.0 / nullif(sqrt(CAST((s_nationkey * s_nationkey) + (s_suppkey % 7) * (s_suppkey % 7) AS DOUBLE)), 0), 6) AS scale FROM supplier""")
def metric_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Millimetres per pixel of a measured segment (M8, J9); null for a segment without length."""
    s = table(spark, folder, "supplier")
    dims = s.select(F.col("s_suppkey").alias("segment_id"), F.lit(600.0).alias("millimetres"), F.lit(0.95).alias("confidence"))
    seg = s.select(F.col("s_suppkey").alias("segment_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("s_nationkey").alias("x2"), (F.col("s_suppkey") % 7).alias("y2"))
    return rounded(sessions.segment_scale(dims, seg), scale=6).select("segment_id", "scale")


@query("""
SELECT l_suppkey AS session_id, round(sum(600.0 / l_quantity * (l_linenumber / 10.0)) / sum(l_linenumber / 10.0), 6) AS scale, count(*) AS n FROM lineitem GROUP BY 1""")
def scale_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Scale of several dimensions, weighted by confidence."""
    s = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("session_id"), (600.0 / F.col("l_quantity")).alias("scale"), (F.col("l_linenumber") / 10.0).alias("confidence"))
    return rounded(sessions.estimate_scale(s), scale=6)


@query("""
SELECT event_id, round(800.0 * 120.0 / nullif(value, 0), 4) AS z, round((user_id - 320.0) * (800.0 * 120.0 / nullif(value, 0)) / 800.0, 4) + 0.0 AS x FROM events""")
def stereo_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Depth from disparity (A3, M9)."""
    x, _, z = im.stereo_point("user_id", F.lit(0.0), "value", 800.0, 120.0, 320.0, 240.0)
    return rounded(table(spark, folder, "events").select("event_id", z.alias("z"), x.alias("x")), z=4, x=4)


@query("""
WITH c AS (SELECT vec_id, (vec_id % 97) / 100.0 AS c1, (vec_id % 89) / 100.0 AS c2, (vec_id % 83) / 100.0 AS c3 FROM embeddings)
SELECT vec_id, round((c1 + c2 + c3) / 3, 8) AS frame, round((c1 + c2) / 2, 8) AS plane, round(least(1.0, (c1 + c2 + c3) / 3 + 0.15), 8) AS box FROM c""")
def confidence_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Confidences of a frame, a plane and a box."""
    c = table(spark, folder, "embeddings").select("vec_id", *[((F.col("vec_id") % m) / 100.0).alias(n) for n, m in (("c1", 97), ("c2", 89), ("c3", 83))])
    return rounded(c.select("vec_id", im.frame_confidence("c1", "c2", "c3").alias("frame"), im.plane_confidence("c1", "c2").alias("plane"), im.box_confidence("c1", "c2", "c3").alias("box")), frame=8, plane=8, box=8)


@query("""
WITH d AS (SELECT event_id, (event_id % 1280 - 640.0) / 900.0 AS a, (user_id % 960 - 480.0) / 900.0 AS b FROM events)
SELECT event_id, round(a / sqrt(a*a + b*b + 1), 8) + 0.0 AS dx, round(b / sqrt(a*a + b*b + 1), 8) + 0.0 AS dy, round(1 / sqrt(a*a + b*b + 1), 8) AS dz FROM d""")
def vp_direction(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel or vanishing point to a direction (M4)."""
    e = table(spark, folder, "events")
    d = im.pixel_direction(F.col("event_id") % 1280, F.col("user_id") % 960, 900.0, 900.0, 640.0, 480.0)
    return rounded(e.select("event_id", *[x.alias(n) for x, n in zip(d, ("dx", "dy", "dz"))]), dx=8, dy=8, dz=8)


@query("""
WITH s AS (SELECT o_custkey AS session_id, count(*) AS photos FROM orders GROUP BY 1) SELECT session_id, photos, photos >= 12 AS enough FROM s""")
def capture_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Photos per session against the suggested dozen (S1): customers stand in for sessions, orders for photos."""
    return sessions.capture_progress(table(spark, folder, "orders").select(F.col("o_custkey").alias("session_id")))


@query("""
SELECT o_custkey AS session_id, count(*) AS photos, count(*) BETWEEN 18 AND 36 AND min(0.71 + o_totalprice * 0) > 0.7 AND count(DISTINCT o_orderstatus) >= 2 AND count_if(o_orderpriority <> '5-LOW') >= 3 AS accepted FROM orders GROUP BY 1""")
def capture_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Minimum-capture policy."""
    shots = table(spark, folder, "orders").select(F.col("o_custkey").alias("session_id"), F.lit(0.71).alias("overlap"), F.col("o_orderstatus").alias("height_id"), (F.col("o_orderpriority") != "5-LOW").alias("scale_visible"))
    return sessions.capture_policy(shots)


@query("""
SELECT p_brand AS assembly, round(sum(p_size / 50.0 * p_retailprice) / sum(p_retailprice), 6) AS confidence, count(*) AS shapes FROM part GROUP BY 1""")
def assembly_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Assembly confidence and shape counts."""
    s = table(spark, folder, "part").select(F.col("p_brand").alias("assembly"), (F.col("p_size") / 50.0).alias("confidence"), "p_retailprice")
    return rounded(sessions.assembly_confidence(s, weight="p_retailprice"), confidence=6)


@query("""
SELECT p_partkey AS part_id, coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_retailprice END, CAST(p_size AS DOUBLE)) AS length FROM part""")
def manual_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """What the operator entered in place of estimates."""
    p = table(spark, folder, "part")
    parts = p.select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("double").alias("length"))
    return sessions.with_manual_dimensions(parts, p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("part_id"), F.col("p_retailprice").alias("length")), "part_id", ("length",))


@query("""
SELECT DISTINCT o_clerk_like AS dataset FROM (SELECT o_orderpriority || '/' || (o_custkey % 50) AS o_clerk_like FROM orders)
WHERE o_clerk_like NOT IN (SELECT '1-URGENT/' || (c_custkey % 50) FROM customer)""")
def manifest_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries without a license."""
    manifest = table(spark, folder, "orders").select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("dataset"))
    registry = table(spark, folder, "customer").select(F.concat(F.lit("1-URGENT/"), (F.col("c_custkey") % 50).cast("string")).alias("dataset"))
    return graphs.manifest_audit(manifest, registry).distinct()


@query("""
WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 2 = 1), b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_id % 2 = 0)
SELECT a.user_id, a.event_id, arg_max(b.value, (b.ts, b.event_id)) AS value FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1, 2""")
def latest_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The latest sample at or before each frame (J6 as an as-of join), by one sort."""
    e = table(spark, folder, "events")
    left = e.where("event_id % 2 = 1").select("user_id", "ts", "event_id")
    right = e.where("event_id % 2 = 0").select("user_id", "ts", "value", F.col("event_id").alias("tie"))
    return graphs.as_of(left, right, ("user_id",), "ts", "value", "tie").select("user_id", "event_id", "value")


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS c FROM lineitem), i AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM s),
k AS (SELECT r % 50 AS view_id, r, min(c) AS x1, max(c) AS x2 FROM i GROUP BY r, g HAVING max(c) - min(c) >= 3),
e AS (SELECT view_id, string_agg(printf('0\nLINE\n8\nBORDES\n10\n%.6f\n20\n%.6f\n11\n%.6f\n21\n%.6f', x1::DOUBLE, (100000 - r)::DOUBLE, x2::DOUBLE, (100000 - r)::DOUBLE), chr(10) ORDER BY r, x1) AS body FROM k GROUP BY 1)
SELECT view_id, md5(replace('0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n', '\n', chr(10)) || replace(body, '\n', chr(10)) || replace('\n0\nENDSEC\n0\nEOF', '\n', chr(10))) AS digest FROM e""".replace("\n0\nLINE", "\\n0\\nLINE"))
def dxf_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of drawings."""
    cells = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("view_id"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"))
    found = segments.drawing_segments(segments.runs(cells, 3), 100_000)
    return sinks.dxf(found).select("view_id", F.md5("text").alias("digest"))


_TURNED = ", ".join(f"p.a{3 * i} * s.r{j} + p.a{3 * i + 1} * s.r{3 + j} + p.a{3 * i + 2} * s.r{6 + j}" for i in range(3) for j in range(3))


@query(f"""
WITH RECURSIVE q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value AS tx, value / 1000 AS x, 0.01 AS y, 2.0 / (1 + value / 1000 * value / 1000 + 0.0001) AS s FROM events),
s AS (SELECT user_id, k, tx, 1 - s*y*y AS r0, s*x*y AS r1, s*y AS r2, s*x*y AS r3, 1 - s*x*x AS r4, -s*x AS r5, -s*y AS r6, s*x AS r7, 1 - s*(x*x + y*y) AS r8 FROM q),
p(user_id, k, x, y, z, a0, a1, a2, a3, a4, a5, a6, a7, a8) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM events
  UNION ALL SELECT p.user_id, s.k, p.x + p.a0*tx + p.a2, p.y + p.a3*tx + p.a5, p.z + p.a6*tx + p.a8, {_TURNED} FROM p JOIN s ON s.user_id = p.user_id AND s.k = p.k + 1)
SELECT user_id AS session_id, k AS id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, round(a1, 6) + 0.0 AS r1, round(a8, 6) + 0.0 AS r8 FROM p""")
def se3_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Rigid motions folded into poses (W2): users stand in for sessions, events for steps."""
    e = table(spark, folder, "events")
    r = v.quaternion_to_matrix(F.lit(1.0), F.col("value") / 1000, F.lit(0.01), F.lit(0.0))
    moves = e.select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("step_id"), F.col("value").alias("tx"), F.lit(0.0).alias("ty"), F.lit(1.0).alias("tz"), F.array(*r).alias("r"))
    poses = motion.accumulate_poses(moves).select("session_id", "id", *[F.element_at("origin", k + 1).alias(n) for k, n in enumerate("xyz")], F.element_at("rotation", 2).alias("r1"), F.element_at("rotation", 9).alias("r8"))
    return rounded(poses, x=3, y=3, z=3, r1=6, r8=6)


@query("""
WITH m AS (SELECT l_suppkey AS view_id, count(*) AS n, var_pop(x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, var_pop(y) AS d, covar_pop(y, z) AS e, var_pop(z) AS f
  FROM (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem) GROUP BY 1),
q AS (SELECT *, (a + d + f) / 3 AS q FROM m), p AS (SELECT *, sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b*b + c*c + e*e)) / 6) AS p FROM q),
h AS (SELECT *, greatest(-1.0, least(1.0, ((a - q) * ((d - q) * (f - q) - e*e) - b * (b * (f - q) - e*c) + c * (b*e - (d - q) * c)) / nullif(2 * p * p * p, 0))) AS h FROM p)
SELECT view_id, n, round(q + 2 * p * cos(acos(h) / 3), 4) AS l1, round(3 * q - (q + 2 * p * cos(acos(h) / 3)) - (q + 2 * p * cos(acos(h) / 3 + 2 * pi() / 3)), 4) AS l2, round(q + 2 * p * cos(acos(h) / 3 + 2 * pi() / 3), 4) AS l3, TRUE AS orthonormal FROM h""")
def jacobi_pca(spark: SparkSession, folder: str) -> DataFrame:
    """Principal axes of clouds (A7): eigenvalues against their closed form, and whether the axes are orthonormal."""
    e = geometry.principal_axes(geometry.moments(_points(spark, folder), ("view_id",)), ("view_id",))
    axes = [v.vector(f"e{k}x", f"e{k}y", f"e{k}z") for k in (1, 2, 3)]
    off = sum((F.abs(v.dot(axes[i], axes[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i + 1)), F.lit(0.0))
    return rounded(e, l1=4, l2=4, l3=4).select("view_id", "n", "l1", "l2", "l3", (off < 1e-6).alias("orthonormal"))


@query()
def plane_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Robust planes (A10); the tests use synthetic planes."""
    return geometry.fit_planes(_points(spark, folder), ("view_id",))


@query()
def cylinder_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Robust cylinders (A9); the tests use synthetic cylinders."""
    return geometry.fit_cylinders(_points(spark, folder), ("view_id",))


@query()
def vanishing_points(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three vanishing points a view (A5, A6, T4); the tests use synthetic views."""
    s = _points(spark, folder).select("view_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1 + F.col("l_linenumber")).alias("x2"), (F.col("y") + 2 + F.col("l_orderkey") % 5).alias("y2"))
    return geometry.vanishing_points(s, tolerance=0.5)


@query("""
WITH RECURSIVE cells AS (SELECT DISTINCT l_orderkey // 8 AS view_id, l_orderkey AS r, l_linenumber AS c FROM lineitem),
near AS (SELECT a.view_id, a.r * 8 + a.c AS a, b.r * 8 + b.c AS b FROM cells a JOIN cells b ON a.view_id = b.view_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach(view_id, node, root) AS (SELECT view_id, a, a FROM near UNION SELECT n.view_id, n.b, root FROM reach JOIN near n ON n.view_id = reach.view_id AND n.a = reach.node WHERE n.b > root),
least AS (SELECT view_id, node, min(root) AS root FROM reach GROUP BY 1, 2)
SELECT view_id, node // 8 AS r, node % 8 AS c, root // 8 AS first_r, root % 8 AS first_c FROM least""")
def edge_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of edge cells (A13), told by their first cell: orders are rows, eight a view, line numbers columns."""
    cells = table(spark, folder, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("view_id"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"))
    found = segments.edge_components(cells)
    first = F.min(F.struct("r", "c")).over(Window.partitionBy("view_id", "component"))
    return found.withColumn("f", first).select("view_id", "r", "c", F.col("f.r").alias("first_r"), F.col("f.c").alias("first_c"))


from . import capture_queries, document_queries, scene_queries  # noqa: E402, F401  they register themselves
