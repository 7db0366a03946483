"""Queries of the sinks: digests of whole documents, with SQL that writes the same texts by itself.

Numeric columns stand in for coordinates. They have few decimals, so no format has to decide a tie.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query, table
from .sources import sinks


def told(template: str, **parts: str) -> str:
    """SQL for a text whose {names} are filled with expressions."""
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    return " || ".join(parts[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'" for p in pieces)


def num(expression: str, decimals: int) -> str:
    return f"printf('%.{decimals}f', CAST({expression} AS DOUBLE))"


def vec(*xs: str, decimals: int = 6) -> str:
    return told("App.Vector({a}, {b}, {c})", **{n: num(x, decimals) for n, x in zip("abc", xs)})


def macro(document: str, groups: str, body: str, order: str, rows: str) -> str:
    """SQL for a macro's digest from a body for each row of `rows`, which has a column doc."""
    opens = "import FreeCAD as App\nimport FreeCADGui as Gui\nimport Part\n\n" + f"doc = App.newDocument('{document}')\n{groups}"
    ends = "\ndoc.recompute()\nGui.activeDocument().activeView().viewAxonometric()\nGui.activeDocument().activeView().fitAll()"
    return f"SELECT doc, md5({told(opens)} || string_agg(body, chr(10) ORDER BY {order}) || {told(ends)}) AS digest FROM (SELECT *, {body} AS body FROM ({rows})) GROUP BY doc"


def digests(documents: DataFrame, key: str = "doc") -> DataFrame:
    return documents.select(key, F.md5("text").alias("digest"))


_NOTE = "Estimacion movil; validar cotas antes de fabricar"


@query(macro("LevantamientoIA", "", told("obj = doc.addObject('Part::Cylinder', 'CilindroReconocido')\nobj.Radius = {r}\nobj.Height = {h}\nobj.addProperty('App::PropertyString', 'Origen')\nobj.Origen = '" + _NOTE + "'", r=num("p_size", 1), h=num("p_size * 2 + 0.5", 1)), "p_size", "SELECT *, p_partkey AS doc FROM part"))
def cylinder_macros(spark: SparkSession, folder: str) -> DataFrame:
    """One cylinder a macro (K1): parts stand in for captures."""
    p = table(spark, folder, "part")
    return digests(sinks.cylinder_macro(p.select(F.col("p_partkey").alias("doc"), F.col("p_size").cast("double").alias("radius"), (F.col("p_size") * 2 + F.lit(0.5)).cast("double").alias("height"))))


_PART = told(
    "obj{k} = doc.addObject('Part::{t}', 'Parte_{k}')\nobj{k}.Label = 'Parte_{k}'\n{dims}\nobj{k}.Placement.Base = {base}\nobj{k}.addProperty('App::PropertyFloat', 'ConfianzaIA', 'Levantamiento')\nobj{k}.ConfianzaIA = {conf}\n"
    "obj{k}.addProperty('App::PropertyString', 'Origen', 'Levantamiento')\nobj{k}.Origen = '" + _NOTE + "'\ngrupo.addObject(obj{k})\n",
    k="CAST(p_partkey AS VARCHAR)", t="CASE p_partkey % 4 WHEN 0 THEN 'Cylinder' WHEN 1 THEN 'Sphere' WHEN 2 THEN 'Cone' ELSE 'Box' END", conf=num("p_size + 0.25", 2), base=vec("p_size", "-p_size / 2.0", "0", decimals=3),
    dims="CASE p_partkey % 4 WHEN 0 THEN " + told("obj{k}.Radius = {r}\nobj{k}.Height = {h}", k="p_partkey", r=num("p_size", 3), h=num("p_size * 3", 3)) + " WHEN 1 THEN " + told("obj{k}.Radius = {r}", k="p_partkey", r=num("p_size", 3))
    + " WHEN 2 THEN " + told("obj{k}.Radius1 = {r}\nobj{k}.Radius2 = {s}\nobj{k}.Height = {h}", k="p_partkey", r=num("p_size", 3), s=num("p_size / 4.0", 3), h=num("p_size * 3", 3)) + " ELSE " + told("obj{k}.Length = {l}\nobj{k}.Width = {w}\nobj{k}.Height = {h}", k="p_partkey", l=num("p_size * 2", 3), w=num("p_size / 2.0", 3), h=num("p_size * 3", 3)) + " END",
)


@query(macro("PoleaIA", "grupo = doc.addObject('App::DocumentObjectGroup', 'PrimitivasDetectadas')\n", _PART, "p_partkey", "SELECT *, p_partkey // 16 AS doc FROM part"))
def assembly_macros(spark: SparkSession, folder: str) -> DataFrame:
    """Grouped assemblies (K2): sixteen parts a macro, of all four kinds, with percent confidences."""
    p, kind = table(spark, folder, "part"), F.col("p_partkey") % 4
    size = F.col("p_size").cast("double")
    rows = p.select(
        F.floor(F.col("p_partkey") / 16).alias("doc"), F.col("p_partkey").alias("part_id"), F.element_at(F.array(*[F.lit(x) for x in ("cylinder", "sphere", "cone", "box")]), (kind + 1).cast("int")).alias("kind"), F.concat(F.lit("Parte_"), F.col("p_partkey").cast("string")).alias("label"),
        F.when(kind < 3, size).alias("radius"), F.when(kind == 2, size / 4).alias("radius2"), F.when(kind == 3, size * 2).alias("length"), F.when(kind == 3, size / 2).alias("width"), F.when(kind != 1, size * 3).alias("height"),
        size.alias("x"), (-size / 2).alias("y"), F.lit(0.0).alias("z"), (size + 0.25).alias("confidence"),
    )
    return digests(sinks.assembly_macro(rows))


_SPATIAL = "SELECT doc, part, k, body AS line FROM (SELECT s_nationkey AS doc, 0 AS part, s_suppkey AS k, " + told("Vector_{k} = doc.addObject('Part::Feature', 'Vector_{k}')\nVector_{k}.Shape = Part.makeLine({a}, {b})\nVector_{k}.addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = {c}\nvectors.addObject(Vector_{k})", k="CAST(s_suppkey AS VARCHAR)", a=vec("s_suppkey", "s_nationkey / 2.0", "0.25"), b=vec("s_suppkey + 0.5 * s_nationkey", "s_nationkey / 2.0 - 0.25 * s_nationkey", "0.25 + 0.125 * s_nationkey"), c=num("(s_suppkey % 32) / 32.0", 5)) + " AS body FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey, " + told("P{k} = doc.addObject('Part::Feature', 'P{k}')\nP{k}.Shape = Part.makeSphere(1.5, {p})\ncloud.addObject(P{k})", k="CAST(c_custkey AS VARCHAR)", p=vec("c_custkey / 4.0", "c_custkey % 100", "1250")) + " FROM customer)"


@query(macro("ReconstruccionEspacialIA", "frames = doc.addObject('App::DocumentObjectGroup', 'MarcosCamara')\nvectors = doc.addObject('App::DocumentObjectGroup', 'VectoresEspaciales')\ncloud = doc.addObject('App::DocumentObjectGroup', 'NubeDispersa')\n", "line", "part, k", _SPATIAL))
def spatial_macros(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and spheres (K3, M7): suppliers stand in for vectors, customers for points, nations for scenes."""
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    d = lambda *xs: F.array(*[F.lit(x) if isinstance(x, float) else x.cast("double") for x in xs])
    vectors = s.select(F.col("s_nationkey").cast("long").alias("doc"), F.col("s_suppkey").alias("vector_id"), d(F.col("s_suppkey"), F.col("s_nationkey") / 2, 0.25).alias("origin"), d(0.5, -0.25, 0.125).alias("direction"), F.col("s_nationkey").cast("double").alias("lengthMm"), ((F.col("s_suppkey") % 32) / 32).alias("confidence"))
    points = c.select(F.col("c_nationkey").cast("long").alias("doc"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") / 4).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"), F.lit(1250.0).alias("z"))
    return digests(sinks.spatial_macro(vectors, points))


_SOLID = told("obj{k} = doc.addObject('Part::Feature', 'Solido_{k}')\nobj{k}.Shape = Part.{make}({a}, {b}, {base}, {dir})\nobj{k}.addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = {c}\nobj{k}.addProperty('App::PropertyLength', 'Residual').Residual = {r}\ngrp.addObject(obj{k})", k="CAST(p_partkey AS VARCHAR)", make="CASE WHEN p_partkey % 2 = 0 THEN 'makeCylinder' ELSE 'makePlane' END", a=num("p_size", 6), b=num("p_size * 2.5", 6), base=vec("p_size", "0", "-0.5"), dir=vec("0", "0", "1"), c=num("(p_partkey % 32) / 32.0", 6), r=num("p_size / 64.0", 6))


@query(macro("ReconstruccionParametrica", "grp = doc.addObject('App::DocumentObjectGroup', 'GeometriaIA')\n", _SOLID, "p_partkey", "SELECT *, p_partkey // 16 AS doc FROM part"))
def solids_macros(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted solids (K4): even parts are cylinders, odd ones planes."""
    p, size = table(spark, folder, "part"), F.col("p_size").cast("double")
    d = lambda *xs: F.array(*[F.lit(x) if isinstance(x, float) else x for x in xs])
    rows = p.select(F.floor(F.col("p_partkey") / 16).alias("doc"), F.col("p_partkey").alias("solid_id"), F.when(F.col("p_partkey") % 2 == 0, "cylinder").otherwise("plane").alias("kind"), F.concat(F.lit("Solido_"), F.col("p_partkey").cast("string")).alias("name"), size.alias("size1"), (size * 2.5).alias("size2"), d(size, 0.0, -0.5).alias("base"), d(0.0, 0.0, 1.0).alias("direction"), ((F.col("p_partkey") % 32) / 32).alias("confidence"), (size / 64).alias("residual"))
    return digests(sinks.solids_macro(rows))


_AXES = [("X", "1.0,0.2,0.2", ("500", "0", "0")), ("Y", "0.2,1.0,0.2", ("0", "300", "400")), ("Z", "0.2,0.4,1.0", ("0", "-400", "300"))]
_AXIS_ROWS = " UNION ALL ".join(f"SELECT s_suppkey AS doc, {k} AS k, " + told(f"Eje{n}_PuntoFuga = doc.addObject('Part::Feature', 'Eje{n}_PuntoFuga')\nEje{n}_PuntoFuga.Shape = Part.makeLine({{o}}, {{e}})\nEje{n}_PuntoFuga.ViewObject.LineColor = ({c})\ngrp.addObject(Eje{n}_PuntoFuga)", o=vec("0", "0", "0"), e=vec(*xs)) + " AS line FROM supplier" for k, (n, c, xs) in enumerate(_AXES))
_EDGE = {"x": vec("375", "0", "0"), "y": vec("0", "225", "300"), "z": vec("0", "-300", "225")}
_CANDIDATES = (("extrusion_axis", "x", "Familia dominante de líneas paralelas proyectadas hacia un punto de fuga"), ("plane", "xy", "Dos familias de paralelas definen direcciones de un plano"), ("box", "xyz", "Tres puntos de fuga ortogonalizados definen un marco cartesiano tipo Manhattan"))
_CANDIDATE_ROWS = " UNION ALL ".join(
    f"SELECT s_suppkey AS doc, {k + 3} AS k, " + told(f"cand{k} = doc.addObject('Part::Feature', 'cand{k}')\ncand{k}.Shape = Part.makeCompound([{', '.join(f'Part.makeLine({{o}}, {{{a}}})' for a in axes)}])\ncand{k}.addProperty('App::PropertyString', 'TipoIA').TipoIA = '{kind}'\ncand{k}.addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = {{c}}\ncand{k}.addProperty('App::PropertyString', 'RazonIA').RazonIA = '{why}'\ngrp.addObject(cand{k})", o=vec("0", "0", "0"), c=num(f"(s_suppkey % 16) / 16.0 + {k}", 6), **_EDGE) + f" AS line FROM supplier WHERE s_suppkey % 3 >= {k}"
    for k, (kind, axes, why) in enumerate(_CANDIDATES)
)


@query(macro("MarcoPerspectivo", "grp = doc.addObject('App::DocumentObjectGroup', 'MarcoPerspectivoIA')\n", "line", "k", f"{_AXIS_ROWS} UNION ALL {_CANDIDATE_ROWS}"))
def perspective_macros(spark: SparkSession, folder: str) -> DataFrame:
    """Axes and candidates (K5, M18): suppliers stand in for views, with one to three candidates."""
    s = table(spark, folder, "supplier")
    array = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    candidate = lambda k, kind: F.struct(F.lit(kind).alias("type"), F.lit(kind).alias("name"), ((F.col("s_suppkey") % 16) / 16 + k).alias("confidence"))
    every = F.array(*[candidate(k, c[0]) for k, c in enumerate(_CANDIDATES)])
    return digests(sinks.perspective_macro(s.select(F.col("s_suppkey").alias("doc"), array(1, 0, 0).alias("xAxis"), array(0, 0.6, 0.8).alias("yAxis"), array(0, -0.8, 0.6).alias("zAxis"), F.slice(every, 1, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("geometryCandidates"))))


_LINES = "; ".join(["ply", "format ascii 1.0", "element vertex ", "property float x", "property float y", "property float z", "end_header"]).split("; ")


@query("WITH n AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM customer) " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS line, '{t}'{' || n' if t.endswith('vertex ') else ''} AS text FROM n" for k, t in enumerate(_LINES)) + " UNION ALL SELECT c_custkey + 7, CAST(c_custkey / 4.0 AS DOUBLE) || ' ' || CAST(c_nationkey AS DOUBLE) || ' ' || CAST(c_custkey % 8 / 8.0 AS DOUBLE) FROM customer")
def ply_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """One cloud as numbered lines (K7): customers stand in for points."""
    c = table(spark, folder, "customer")
    return sinks.ply_lines(c.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") / 4).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 8 / 8).alias("z")))


def _list(*xs: str) -> str:
    return told("[" + ",".join(f"{{x{k}}}" for k in range(len(xs))) + "]", **{f"x{k}": x for k, x in enumerate(xs)})


def _nums(decimals: int, *xs: str) -> str:
    return _list(*[num(x, decimals) for x in xs])


_POSE = told('{l}"id":{i},"origin":{o},"xAxis":{x},"yAxis":{y},"zAxis":{z}{e}', l="'{'", e="'}'", i="CAST(s_suppkey AS VARCHAR)", o=_nums(4, "s_suppkey", "0", "0.5"), x=_nums(7, "1", "0", "0"), y=_nums(7, "0", "0.6", "0.8"), z=_nums(7, "0", "-0.8", "0.6"))


@query("SELECT s_nationkey AS doc, md5('{\"coordinateSystem\":\"right-handed-mm\",\"poses\":[' || string_agg(" + _POSE + ", ',' ORDER BY s_suppkey) || ']}') AS digest FROM supplier GROUP BY 1")
def trajectory_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories (K8): suppliers stand in for poses, nations for sessions."""
    array = lambda *xs: F.array(*[F.lit(float(x)) if not isinstance(x, str) else F.col(x).cast("double") for x in xs])
    pose = F.struct(F.col("s_suppkey").alias("id"), array("s_suppkey", 0, 0.5).alias("origin"), array(1, 0, 0).alias("xAxis"), array(0, 0.6, 0.8).alias("yAxis"), array(0, -0.8, 0.6).alias("zAxis"))
    docs = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.lit("right-handed-mm").alias("coordinateSystem"), F.array_sort(F.collect_list(pose)).alias("poses"))
    return digests(sinks.trajectory_json(docs))


_R_POSE = told('{l}"id":{i},"origin":{o},"rotation":{r}{e}', l="'{'", e="'}'", i="CAST(s_suppkey AS VARCHAR)", o=_nums(6, "s_suppkey", "0", "0.5"), r=_nums(8, *"100010001"))
_R_POINT = told("[{a},{b}]", a=" || ',' || ".join(num(x, 6) for x in ("s_suppkey", "s_nationkey", "1250")), b=num("0.75", 5))
_R_VECTOR = told('{l}"name":"v{i}","origin":{o},"direction":{d},"lengthMm":{m},"confidence":{c}{e}', l="'{'", e="'}'", i="CAST(s_suppkey AS VARCHAR)", o=_nums(6, "0", "0", "0"), d=_nums(8, "0", "0", "1"), m=num("s_suppkey", 3), c=num("0.5", 4))


@query("SELECT s_nationkey AS doc, md5('{\"coordinateSystem\":\"right-handed-mm\",\"poses\":[' || string_agg(" + _R_POSE + ", ',' ORDER BY s_suppkey) || '],\"points\":[' || string_agg(" + _R_POINT + ", ',' ORDER BY s_suppkey) || '],\"vectors\":[' || string_agg(" + _R_VECTOR + ", ',' ORDER BY s_suppkey) || ']}') AS digest FROM supplier GROUP BY 1")
def reconstruction_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reconstructions (K9): each supplier is a pose, a point and a vector of its nation's scene."""
    array = lambda *xs: F.array(*[F.lit(float(x)) if not isinstance(x, str) else F.col(x).cast("double") for x in xs])
    each = F.struct(
        F.col("s_suppkey").alias("at"), F.struct(F.col("s_suppkey").alias("id"), array("s_suppkey", 0, 0.5).alias("origin"), array(*map(float, "100010001")).alias("rotation")).alias("pose"), array("s_suppkey", "s_nationkey", 1250, 0.75).alias("point"),
        F.struct(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("name"), array(0, 0, 0).alias("origin"), array(0, 0, 1).alias("direction"), F.col("s_suppkey").cast("double").alias("lengthMm"), F.lit(0.5).alias("confidence")).alias("vector"),
    )
    docs = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.array_sort(F.collect_list(each)).alias("e"))
    return digests(sinks.reconstruction_json(docs.select("doc", F.lit("right-handed-mm").alias("coordinateSystem"), F.transform("e", lambda x: x.pose).alias("poses"), F.transform("e", lambda x: x.point).alias("points"), F.transform("e", lambda x: x.vector).alias("vectors"))))


_VP = told('{l}"u":{u},"v":{v},"confidence":{c}{e}', l="'{'", e="'}'", u=num("s_suppkey / 4.0", 8), v=num("-s_nationkey", 8), c=num("0.375", 8))
_CAND = told('{l}"type":"box","name":"PrismaCartesiano","confidence":{c}{e}', l="'{'", e="'}'", c=num("(s_suppkey % 8) / 8.0", 8))


@query("SELECT s_suppkey AS doc, md5('{\"coordinateSystem\":\"camera-right-handed\",\"xAxis\":' || " + _nums(8, "1", "0", "0") + " || ',\"yAxis\":' || " + _nums(8, "0", "0.6", "0.8") + " || ',\"zAxis\":' || " + _nums(8, "0", "-0.8", "0.6") + " || ',\"confidence\":' || " + num("0.5", 8) + " || ',\"vanishingPoints\":[' || " + _VP + " || '],\"geometryCandidates\":[' || " + _CAND + " || ']}') AS digest FROM supplier")
def perspective_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Perspective frames as documents (K10): suppliers stand in for views."""
    array = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    vp = F.struct((F.col("s_suppkey") / 4).alias("u"), (-F.col("s_nationkey")).cast("double").alias("v"), F.lit(0.375).alias("confidence"))
    cand = F.struct(F.lit("box").alias("type"), F.lit("PrismaCartesiano").alias("name"), ((F.col("s_suppkey") % 8) / 8).alias("confidence"))
    docs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc"), F.lit("camera-right-handed").alias("coordinateSystem"), array(1, 0, 0).alias("xAxis"), array(0, 0.6, 0.8).alias("yAxis"), array(0, -0.8, 0.6).alias("zAxis"), F.lit(0.5).alias("confidence"), F.array(vp).alias("vanishingPoints"), F.array(cand).alias("geometryCandidates"))
    return digests(sinks.perspective_json(docs))


@query("""
SELECT s_suppkey AS doc, md5('{"coordinateSystem":"image-perspective-to-3d","aiHypotheses":[{"type":"BOX","label":"Prisma posible","confidence":' || CAST((s_suppkey % 8) / 8.0 AS DOUBLE) || '}],"manualConstraints":[{"type":"LINE","points":[0.0,0.5,'
  || CAST(s_suppkey AS DOUBLE) || ',' || CAST(s_nationkey AS DOUBLE) || '],"meaning":"eje"}]}') AS digest FROM supplier""")
def constraint_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Hypotheses and manual constraints as documents (K11, F8): suppliers stand in for views."""
    s = table(spark, folder, "supplier")
    ai = F.array(F.struct(F.lit("BOX").alias("type"), F.lit("Prisma posible").alias("label"), ((F.col("s_suppkey") % 8) / 8).alias("confidence")))
    manual = F.array(F.struct(F.lit("LINE").alias("type"), F.array(F.lit(0.0), F.lit(0.5), F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")).alias("points"), F.lit("eje").alias("meaning")))
    return digests(sinks.struct_json(s.select(F.col("s_suppkey").alias("doc"), F.lit("image-perspective-to-3d").alias("coordinateSystem"), ai.alias("aiHypotheses"), manual.alias("manualConstraints"))))


@query("""
SELECT p_partkey AS doc, md5('{"proposal":{"type":"BOX","visualConfidence":0.5},"refinedModel":{"metricCalibrated":' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END || ',"scaleMmPerPixel":' || CAST(p_size / 4.0 AS DOUBLE) || '},"nextCapture":{"instruction":"'
  || CASE WHEN p_size <= 20 THEN 'Marca la base e ingresa una medida real' WHEN p_partkey % 5 < 3 THEN 'Muévete 25 grados hacia la derecha manteniendo visible la base' ELSE 'Captura completa' END || '","reason":"'
  || CASE WHEN p_size <= 20 THEN 'Falta escala métrica' WHEN p_partkey % 5 < 3 THEN 'Se necesita paralaje para calcular profundidad' ELSE 'Hay vistas y escala suficientes' END || '"}}') AS digest FROM part""")
def refinement_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Refined models with the next capture's guidance (K12, F10): parts stand in for proposals."""
    from .operators import sessions

    p = table(spark, folder, "part")
    calibrated = F.col("p_size") > 20
    docs = p.select(F.col("p_partkey").alias("doc"), F.struct(F.lit("BOX").alias("type"), F.lit(0.5).alias("visualConfidence")).alias("proposal"), F.struct(calibrated.alias("metricCalibrated"), (F.col("p_size") / 4).alias("scaleMmPerPixel")).alias("refinedModel"), sessions.next_capture(calibrated, F.col("p_partkey") % 5).alias("nextCapture"))
    return digests(sinks.struct_json(docs))


@query("""
WITH s AS (SELECT p_partkey // 16 AS assembly, upper(p_brand) AS class, p_size / 64.0 AS confidence, 'size ' || p_size AS reason FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY confidence DESC, class, reason) AS k FROM s),
t AS (SELECT assembly, string_agg(class || ' ' || printf('%.2f', confidence::DOUBLE) || ' ' || reason, chr(10) ORDER BY k) FILTER (k <= 8) AS body, count(*) AS shapes FROM r GROUP BY 1)
SELECT assembly, md5('assembly=' || assembly || ' conf=0.5000' || chr(10) || 'shapes=' || shapes || ' relations=10' || chr(10) || body) AS digest FROM t""".replace("p_size / 64.0 AS", "p_size / 50.0 AS"))
def vocabulary_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked shapes of assemblies as text (K13, T1, G8): sixteen parts an assembly, the eight best are told."""
    p = table(spark, folder, "part")
    assembly = F.floor(F.col("p_partkey") / 16)
    shapes = p.select(assembly.alias("assembly"), F.upper("p_brand").alias("class"), (F.col("p_size") / 50).alias("confidence"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("reason"))
    heads = shapes.groupBy("assembly").agg(F.lit(0.5).alias("confidence"), F.count("*").alias("shapes"), F.lit(10).alias("relations"))
    return digests(sinks.vocabulary_report(shapes, heads), "assembly")


@query("""
SELECT c_custkey AS doc, md5('{"device_id":' || c_custkey || ',"sessions":' || c_nationkey || ',"confirmed":' || c_custkey % 7 || ',"corrections":' || c_custkey % 3 || ',"mean_quality":' || CAST((c_custkey % 8) / 8.0 AS DOUBLE) || ',"maturity":' || CAST(c_custkey % 4 / 4.0 AS DOUBLE) || '}') AS digest FROM customer""")
def passport_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Passports without anything sensitive (K14, F7): names and phones of customers do not get through."""
    c = table(spark, folder, "customer")
    rows = c.select("*", F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("sessions"), (F.col("c_custkey") % 7).alias("confirmed"), (F.col("c_custkey") % 3).alias("corrections"), ((F.col("c_custkey") % 8) / 8).alias("mean_quality"), ((F.col("c_custkey") % 4) / 4).alias("maturity"))
    return digests(sinks.passport_json(rows))


@query("SELECT (SELECT count(*) FROM lineitem) AS features, (SELECT count(*) FROM orders) AS matches, (SELECT count(*) FROM customer) AS points")
def reconstruction_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many features, matches and points."""
    return sinks.reconstruction_report(*(table(spark, folder, t) for t in ("lineitem", "orders", "customer")))


@query("""
WITH l AS (SELECT l_suppkey AS view_id, l_linenumber::DOUBLE AS cx, l_orderkey::DOUBLE AS cy, l_quantity::DOUBLE AS radius FROM lineitem),
b AS (SELECT view_id, string_agg(printf('0\nCIRCLE\n8\nBORDES\n10\n%.6f\n20\n%.6f\n40\n%.6f', cx, cy, radius), chr(10) ORDER BY cy DESC, cx, printf('%.6f', radius)) AS body FROM l GROUP BY 1)
SELECT view_id, md5('0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n' || body || '\n0\nENDSEC\n0\nEOF') AS digest FROM b""")
def dxf_circles(spark: SparkSession, folder: str) -> DataFrame:
    """Drawings of circles (K6b): line items stand in for holes, suppliers for views."""
    line = table(spark, folder, "lineitem")
    circles = line.select(F.col("l_suppkey").alias("view_id"), F.col("l_linenumber").cast("double").alias("cx"), F.col("l_orderkey").cast("double").alias("cy"), F.col("l_quantity").cast("double").alias("radius"))
    nothing = circles.where("false").select("view_id", *[F.lit(0.0).alias(x) for x in ("x1", "y1", "x2", "y2")])
    return sinks.dxf(nothing, circles=circles).select("view_id", F.md5("text").alias("digest"))
