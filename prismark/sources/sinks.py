"""Sinks: tables as drawings, clouds, macros and JSON documents.

A sink yields rows (doc, text), a whole document each, or (line, text) to be written in order. Bodies are formatted where
the rows lie; only one document's lines meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.imaging import fixed, fixed_list, reason
from ..functions.vectors import along, of_array

# The lines with which every macro opens and ends.
_MACRO_OPENS = ("import FreeCAD as App", "import FreeCADGui as Gui", "import Part", "")
_MACRO_ENDS = ("doc.recompute()", "Gui.activeDocument().activeView().viewAxonometric()", "Gui.activeDocument().activeView().fitAll()")
#: Fixed value: what a part says of its origin.
ORIGIN_NOTE = "Estimacion movil; validar cotas antes de fabricar"


def _document(rows: DataFrame, key: str, order: Sequence[str], body: Column, opens: Column, ends: Column) -> DataFrame:
    """(key, text): the bodies of each key in order, between an opening and an end."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, body.alias("body")))), lambda x: x.body)
    return rows.groupBy(key).agg(lines.alias("lines")).select(key, F.concat_ws("\n", opens, F.array_join("lines", "\n"), ends).alias("text"))


def _macro(rows: DataFrame, key: str, order: Sequence[str], body: Column, document: str, groups: Sequence[tuple[str, str]]) -> DataFrame:
    start = [*_MACRO_OPENS, f"doc = App.newDocument('{document}')", *(f"{v} = doc.addObject('App::DocumentObjectGroup', '{n}')" for v, n in groups)]
    return _document(rows, key, order, body, F.lit("\n".join(start)), F.lit("\n".join(_MACRO_ENDS)))


def _vector(xs: Sequence, decimals: int = 6) -> Column:
    return F.concat(F.lit("App.Vector("), F.concat_ws(", ", *[fixed(x, decimals) for x in xs]), F.lit(")"))


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def cylinder_macro(rows: DataFrame, key: str = "doc") -> DataFrame:
    """One cylinder a document: (doc, radius, height)."""
    body = _lines("obj = doc.addObject('Part::Cylinder', 'CilindroReconocido')", _text("obj.Radius = ", F.format_string("%.1f", "radius")), _text("obj.Height = ", F.format_string("%.1f", "height")), "obj.addProperty('App::PropertyString', 'Origen')", f"obj.Origen = '{ORIGIN_NOTE}'")
    return _macro(rows, key, ["radius", "height"], body, "LevantamientoIA", [])


def assembly_macro(rows: DataFrame, key: str = "doc") -> DataFrame:
    """Parts (doc, part_id, kind, label, radius, radius2, length, width, height, x, y, z, confidence); percent or fraction."""
    obj = F.concat(F.lit("obj"), F.col("part_id").cast("string"))
    put = lambda name, value: F.when(F.col(value).isNotNull(), F.concat(obj, F.lit(f".{name} = "), fixed(value, 3)))
    types = F.when(F.col("kind") == "cylinder", "Part::Cylinder").when(F.col("kind") == "sphere", "Part::Sphere").when(F.col("kind") == "cone", "Part::Cone").otherwise("Part::Box")
    radii = F.when(F.col("kind") == "cone", F.concat_ws("\n", put("Radius1", "radius"), put("Radius2", "radius2"))).otherwise(put("Radius", "radius"))
    percent = F.when(F.col("confidence") > 1, F.col("confidence")).otherwise(F.col("confidence") * 100)
    body = F.concat_ws(
        "\n", _text(obj, " = doc.addObject('", types, "', '", F.col("label"), "')"), _text(obj, ".Label = '", F.col("label"), "'"), radii, put("Length", "length"), put("Width", "width"), put("Height", "height"),
        _text(obj, ".Placement.Base = ", _vector(["x", "y", "z"], 3)), _text(obj, ".addProperty('App::PropertyFloat', 'ConfianzaIA', 'Levantamiento')"), _text(obj, ".ConfianzaIA = ", fixed(percent, 2)),
        _text(obj, ".addProperty('App::PropertyString', 'Origen', 'Levantamiento')"), _text(obj, f".Origen = '{ORIGIN_NOTE}'"), _text("grupo.addObject(", obj, ")\n"),
    )
    return _macro(rows, key, ["part_id"], body, "PoleaIA", [("grupo", "PrimitivasDetectadas")])


def spatial_macro(vectors: DataFrame, points: DataFrame, key: str = "doc", radius: float = 1.5) -> DataFrame:
    """Lines (doc, vector_id, origin, direction, lengthMm, confidence) and spheres (doc, point_id, x, y, z)."""
    origin, direction = of_array("origin"), of_array("direction")
    name = F.concat(F.lit("Vector_"), F.col("vector_id").cast("string"))
    line = _lines(_text(name, " = doc.addObject('Part::Feature', '", name, "')"), _text(name, ".Shape = Part.makeLine(", _vector(origin), ", ", _vector(along(origin, direction, "lengthMm")), ")"), _text(name, ".addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = ", fixed("confidence", 5)), _text("vectors.addObject(", name, ")"))
    ball = F.concat(F.lit("P"), F.col("point_id").cast("string"))
    sphere = _lines(_text(ball, " = doc.addObject('Part::Feature', '", ball, "')"), _text(ball, f".Shape = Part.makeSphere({radius}, ", _vector(["x", "y", "z"]), ")"), _text("cloud.addObject(", ball, ")"))
    both = vectors.select(key, F.lit(0).alias("part"), F.col("vector_id").cast("long").alias("at"), line.alias("line")).unionByName(points.select(key, F.lit(1).alias("part"), F.col("point_id").cast("long").alias("at"), sphere.alias("line")))
    return _macro(both, key, ["part", "at"], F.col("line"), "ReconstruccionEspacialIA", [("frames", "MarcosCamara"), ("vectors", "VectoresEspaciales"), ("cloud", "NubeDispersa")])


def solids_macro(rows: DataFrame, key: str = "doc") -> DataFrame:
    """Fitted solids (doc, solid_id, kind cylinder or plane, name, size1, size2, base, direction, confidence, residual)."""
    obj = F.concat(F.lit("obj"), F.col("solid_id").cast("string"))
    make = F.when(F.col("kind") == "cylinder", "makeCylinder").otherwise("makePlane")
    body = _lines(
        _text(obj, " = doc.addObject('Part::Feature', '", F.col("name"), "')"), _text(obj, ".Shape = Part.", make, "(", fixed("size1", 6), ", ", fixed("size2", 6), ", ", _vector(of_array("base")), ", ", _vector(of_array("direction")), ")"),
        _text(obj, ".addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = ", fixed("confidence", 6)), _text(obj, ".addProperty('App::PropertyLength', 'Residual').Residual = ", fixed("residual", 6)), _text("grp.addObject(", obj, ")"),
    )
    return _macro(rows, key, ["solid_id"], body, "ReconstruccionParametrica", [("grp", "GeometriaIA")])


#: Lengths in mm of a frame's axes and of its candidates, and the colours of X, Y and Z.
AXIS_MM, CANDIDATE_MM = 500, 375
AXIS_COLOURS = {"X": "(1.0,0.2,0.2)", "Y": "(0.2,1.0,0.2)", "Z": "(0.2,0.4,1.0)"}


def perspective_macro(frames: DataFrame, key: str = "doc") -> DataFrame:
    """Frames (doc, xAxis, yAxis, zAxis, geometryCandidates). A candidate is drawn along the axes that it is about."""
    zero = (F.lit(0.0),) * 3

    def line(name: Column, direction: str, mm: int) -> Column:
        return _lines(_text(name, " = doc.addObject('Part::Feature', '", name, "')"), _text(name, ".Shape = Part.makeLine(", _vector(zero), ", ", _vector(along(zero, of_array(direction), mm)), ")"))

    axes = [F.struct(F.lit(k).alias("at"), _lines(line(F.lit(f"Eje{n}_PuntoFuga"), f"{n.lower()}Axis", AXIS_MM), f"Eje{n}_PuntoFuga.ViewObject.LineColor = {c}", f"grp.addObject(Eje{n}_PuntoFuga)").alias("line")) for k, (n, c) in enumerate(AXIS_COLOURS.items())]
    rows = frames.select(key, F.inline(F.array(*axes)))
    each = frames.select(key, "xAxis", "yAxis", "zAxis", F.posexplode("geometryCandidates").alias("at", "c")).select(key, "xAxis", "yAxis", "zAxis", (F.col("at") + 3).alias("at"), F.concat(F.lit("cand"), F.col("at").cast("string")).alias("obj"), "c.type", "c.confidence")
    edges = F.concat_ws(", ", _text("Part.makeLine(", _vector(zero), ", ", _vector(along(zero, of_array("xAxis"), CANDIDATE_MM)), ")"), F.when(F.col("type").isin("plane", "box"), _text("Part.makeLine(", _vector(zero), ", ", _vector(along(zero, of_array("yAxis"), CANDIDATE_MM)), ")")), F.when(F.col("type") == "box", _text("Part.makeLine(", _vector(zero), ", ", _vector(along(zero, of_array("zAxis"), CANDIDATE_MM)), ")")))
    body = _lines(_text(F.col("obj"), " = doc.addObject('Part::Feature', '", F.col("obj"), "')"), _text(F.col("obj"), ".Shape = Part.makeCompound([", edges, "])"), _text(F.col("obj"), ".addProperty('App::PropertyString', 'TipoIA').TipoIA = '", F.col("type"), "'"), _text(F.col("obj"), ".addProperty('App::PropertyFloat', 'ConfianzaIA').ConfianzaIA = ", fixed("confidence", 6)), _text(F.col("obj"), ".addProperty('App::PropertyString', 'RazonIA').RazonIA = '", F.coalesce(reason("type"), F.lit("")), "'"), _text("grp.addObject(", F.col("obj"), ")"))
    rows = rows.unionByName(each.select(key, "at", body.alias("line")))
    return _macro(rows, key, ["at"], F.col("line"), "MarcoPerspectivo", [("grp", "MarcoPerspectivoIA")])


def dxf(segments: DataFrame, key: str = "view_id", layer: str = "BORDES", circles: DataFrame | None = None, polylines: DataFrame | None = None) -> DataFrame:
    """Drawings of segments (x1, y1, x2, y2), circles (cx, cy, radius) and polylines (poly_id, points array of arrays).

    Lines come by falling y, then rising x, as the format has them; circles and polylines follow.
    """
    pairs = lambda *kv: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for p in kv for x in p])
    rows = segments.select(key, F.lit(0).alias("part"), (-F.col("y1")).cast("double").alias("a"), F.col("x1").cast("double").alias("b"), pairs(("0", "LINE"), ("8", layer), ("10", fixed("x1", 6)), ("20", fixed("y1", 6)), ("11", fixed("x2", 6)), ("21", fixed("y2", 6))).alias("line"))
    if circles is not None:
        rows = rows.unionByName(circles.select(key, F.lit(1).alias("part"), (-F.col("cy")).cast("double").alias("a"), F.col("cx").cast("double").alias("b"), pairs(("0", "CIRCLE"), ("8", layer), ("10", fixed("cx", 6)), ("20", fixed("cy", 6)), ("40", fixed("radius", 6))).alias("line")))
    if polylines is not None:
        points = F.array_join(F.transform("points", lambda p: F.concat_ws("\n", F.lit("10"), F.format_string("%.6f", p[0]), F.lit("20"), F.format_string("%.6f", p[1]))), "\n")
        rows = rows.unionByName(polylines.select(key, F.lit(2).alias("part"), F.col("poly_id").cast("double").alias("a"), F.lit(0.0).alias("b"), pairs(("0", "LWPOLYLINE"), ("8", layer), ("90", F.size("points").cast("string")), ("", "")).alias("head"), points.alias("body")).select(key, "part", "a", "b", F.concat_ws("\n", F.regexp_replace("head", "\n\n$", ""), "body").alias("line")))
    opens, ends = "0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES", "0\nENDSEC\n0\nEOF"
    return _document(rows, key, ["part", "a", "b"], F.col("line"), F.lit(opens), F.lit(ends))


def ply_lines(points: DataFrame) -> DataFrame:
    """(line, text) of one cloud (point_id, x, y, z): a header and a row a point, for an ordered write of any size."""
    head = points.agg(F.count("*").alias("n")).select(F.posexplode(F.array(F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("n").cast("string")), *[F.lit(f"property float {c}") for c in "xyz"], F.lit("end_header"))).alias("line", "text"))
    body = points.select((F.col("point_id").cast("long") + 7).alias("line"), F.concat_ws(" ", *[(F.col(c) + F.lit(0.0)).cast("string") for c in "xyz"]).alias("text"))
    return head.select(F.col("line").cast("long").alias("line"), "text").unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (line, text) as text files whose names sort as the lines do."""
    lines.repartitionByRange("line").sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _numbers(array: Column, decimals: int) -> Column:
    return _list(F.transform(array, lambda x: F.format_string(f"%.{decimals}f", x)))


def trajectory_json(docs: DataFrame, key: str = "doc") -> DataFrame:
    """Documents (doc, coordinateSystem, poses) with origins to four decimals and axes to seven."""
    pose = lambda p: F.concat(F.lit('{"id":'), p.id.cast("string"), F.lit(',"origin":'), _numbers(p.origin, 4), *[x for a in ("xAxis", "yAxis", "zAxis") for x in (F.lit(f',"{a}":'), _numbers(p[a], 7))], F.lit("}"))
    return docs.select(key, F.concat(F.lit('{"coordinateSystem":"'), F.col("coordinateSystem"), F.lit('","poses":'), _list(F.transform("poses", pose)), F.lit("}")).alias("text"))


def reconstruction_json(docs: DataFrame, key: str = "doc") -> DataFrame:
    pose = lambda p: F.concat(F.lit('{"id":'), p.id.cast("string"), F.lit(',"origin":'), _numbers(p.origin, 6), F.lit(',"rotation":'), _numbers(p.rotation, 8), F.lit("}"))
    point = lambda p: F.concat(F.lit("["), F.array_join(F.transform(F.slice(p, 1, 3), lambda x: F.format_string("%.6f", x)), ","), F.lit(","), F.format_string("%.5f", p[3]), F.lit("]"))
    vec = lambda v: F.concat(F.lit('{"name":"'), v["name"], F.lit('","origin":'), _numbers(v.origin, 6), F.lit(',"direction":'), _numbers(v.direction, 8), F.lit(',"lengthMm":'), F.format_string("%.3f", v.lengthMm), F.lit(',"confidence":'), F.format_string("%.4f", v.confidence), F.lit("}"))
    return docs.select(key, F.concat(F.lit('{"coordinateSystem":"'), F.col("coordinateSystem"), F.lit('","poses":'), _list(F.transform("poses", pose)), F.lit(',"points":'), _list(F.transform("points", point)), F.lit(',"vectors":'), _list(F.transform("vectors", vec)), F.lit("}")).alias("text"))


def perspective_json(docs: DataFrame, key: str = "doc") -> DataFrame:
    vp = lambda p: F.concat(F.lit('{"u":'), F.format_string("%.8f", p.u), F.lit(',"v":'), F.format_string("%.8f", p.v), F.lit(',"confidence":'), F.format_string("%.8f", p.confidence), F.lit("}"))
    candidate = lambda c: F.concat(F.lit('{"type":"'), c.type, F.lit('","name":"'), c["name"], F.lit('","confidence":'), F.format_string("%.8f", c.confidence), F.lit("}"))
    axes = [x for a in ("xAxis", "yAxis", "zAxis") for x in (F.lit(f',"{a}":'), fixed_list(of_array(a), 8))]
    return docs.select(key, F.concat(F.lit('{"coordinateSystem":"'), F.col("coordinateSystem"), F.lit('"'), *axes, F.lit(',"confidence":'), fixed("confidence", 8), F.lit(',"vanishingPoints":'), _list(F.transform("vanishingPoints", vp)), F.lit(',"geometryCandidates":'), _list(F.transform("geometryCandidates", candidate)), F.lit("}")).alias("text"))


def struct_json(docs: DataFrame, key: str = "doc", columns: Sequence[str] = ()) -> DataFrame:
    """Constraint, refinement and any other documents whose numbers need no fixed decimals."""
    return docs.select(key, F.to_json(F.struct(*(columns or [c for c in docs.columns if c != key]))).alias("text"))


#: Fixed value: all that a passport may tell; photos and whatever else is sensitive is left out by not being here.
PASSPORT_FIELDS = ("device_id", "sessions", "confirmed", "corrections", "mean_quality", "maturity")


def passport_json(passports: DataFrame) -> DataFrame:
    return struct_json(passports.select(*PASSPORT_FIELDS).withColumn("doc", F.col("device_id")), "doc", PASSPORT_FIELDS)


def vocabulary_report(shapes: DataFrame, assemblies: DataFrame, top: int = 8) -> DataFrame:
    """Text reports: shapes (assembly, class, confidence, reason), assemblies (assembly, confidence, shapes, relations)."""
    lines = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("a"), F.col("class").alias("b"), F.concat_ws(" ", "class", F.format_string("%.2f", "confidence"), "reason").alias("line")))), 1, top), lambda x: x.line)
    ranked = shapes.groupBy("assembly").agg(lines.alias("lines"))
    head = F.concat_ws("\n", F.concat(F.lit("assembly="), F.col("assembly"), F.lit(" conf="), fixed("confidence", 4)), F.concat(F.lit("shapes="), F.col("shapes").cast("string"), F.lit(" relations="), F.col("relations").cast("string")))
    return assemblies.join(ranked, "assembly", "left").select("assembly", F.concat_ws("\n", head, F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")).alias("text"))


def reconstruction_report(features: DataFrame, matches: DataFrame, points: DataFrame) -> DataFrame:
    """One row: how many features, matches and points."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("features", features), ("matches", matches), ("points", points))]
    return each[0].unionByName(each[1]).unionByName(each[2]).agg(*[F.max(F.when(F.col("what") == x, F.col("n"))).alias(x) for x in ("features", "matches", "points")])
