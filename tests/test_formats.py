"""Readers on small files of each format, which stand here."""

import json

import pytest
from prismark.sources import readers


@pytest.fixture
def put(tmp_path):
    def run(name, text):
        path = tmp_path / name
        path.write_text(text if isinstance(text, str) else json.dumps(text, indent=1), encoding="utf-8")
        return str(path)

    return run


def test_trajectory(spark, put):
    pose = lambda k, x: {"id": k, "origin": [x, 0.0, -1.5], "xAxis": [1, 0, 0], "yAxis": [0, 1, 0], "zAxis": [0, 0, 1]}
    (doc,) = readers.read_json(spark, put("t.json", {"coordinateSystem": "right-handed-mm", "poses": [pose(0, 0.0), pose(1, 35.25)]}), "trajectory").collect()
    assert doc.coordinateSystem == "right-handed-mm" and [p.origin for p in doc.poses] == [[0.0, 0.0, -1.5], [35.25, 0.0, -1.5]] and doc.poses[1].zAxis == [0.0, 0.0, 1.0]


def test_reconstruction_and_perspective(spark, put):
    rec = {"coordinateSystem": "right-handed-mm", "poses": [{"id": 3, "origin": [1, 2, 3], "rotation": [1, 0, 0, 0, 1, 0, 0, 0, 1]}], "points": [[1.5, -2.0, 1250.0, 0.75]], "vectors": [{"name": "eje", "origin": [0, 0, 0], "direction": [0, 0, 1], "lengthMm": 80.0, "confidence": 0.9}]}
    (doc,) = readers.read_json(spark, put("r.json", rec), "reconstruction").collect()
    assert doc.points == [[1.5, -2.0, 1250.0, 0.75]] and doc.vectors[0].lengthMm == 80.0 and doc.poses[0].rotation[4] == 1.0
    per = {"coordinateSystem": "camera-right-handed", "xAxis": [1, 0, 0], "yAxis": [0, 1, 0], "zAxis": [0, 0, 1], "confidence": 0.33, "vanishingPoints": [{"u": 640.5, "v": -20.0, "confidence": 0.4}], "geometryCandidates": [{"type": "plane", "name": "p", "confidence": 0.38}]}
    (doc,) = readers.read_json(spark, put("p.json", per), "perspective").collect()
    assert doc.vanishingPoints[0].u == 640.5 and doc.geometryCandidates[0].type == "plane"


def test_constraints_keep_both_kinds(spark, put):
    doc = {"coordinateSystem": "image-perspective-to-3d", "aiHypotheses": [{"type": "BOX", "label": "Prisma", "confidence": 0.82}], "manualConstraints": [{"type": "LINE", "points": [1, 2, 3, 4], "meaning": "eje"}, {"type": "ELLIPSE", "bounds": [5, 6, 7, 8], "meaning": "boca"}]}
    got = {r.type: r for r in readers.read_constraints(spark, put("c.json", doc)).collect()}
    assert (got["BOX"].origin, got["BOX"].confidence, got["LINE"].origin) == ("ai", 0.82, "manual")
    assert got["LINE"].points == [1.0, 2.0, 3.0, 4.0] and got["LINE"].bounds is None and got["ELLIPSE"].bounds == [5.0, 6.0, 7.0, 8.0] and got["ELLIPSE"].points is None


def test_refinement(spark, put):
    doc = {"proposal": {"type": "BOX", "label": "Base", "visualConfidence": 0.71}, "realDimensions": [{"kind": "LENGTH", "imageSegment": [0, 0, 400, 20], "millimetres": 600, "confidence": 0.95}], "refinedModel": {"metricCalibrated": True, "scaleMmPerPixel": 1.5}, "nextCapture": {"instruction": "a", "reason": "b"}}
    (r,) = readers.read_json(spark, put("f.json", doc), "refinement").collect()
    assert r.realDimensions[0].millimetres == 600.0 and r.refinedModel.metricCalibrated is True and r.refinedModel.lengthMm is None and r.nextCapture.reason == "b"


def test_annotations(spark, put):
    doc = {"image": "a.jpg", "tags": ["pulley"], "parts": [{"id": 1, "class": "pulley", "parent": None}, {"id": 2, "class": "bolt-pattern", "parent": 1}, {"id": 3, "class": "unheard of", "parent": 1}]}
    path = put("one.json", doc)
    put("two.json", {"image": "b.jpg", "tags": [], "parts": []})
    got = sorted(((r.image, r.part_id, r["class"], r.parent) for r in readers.read_annotations(spark, path.rsplit("/", 1)[0]).collect()), key=str)
    assert got == sorted([("a.jpg", 1, "PULLEY", None), ("a.jpg", 2, "BOLT_PATTERN", 1), ("a.jpg", 3, None, 1), ("b.jpg", None, None, None)], key=str)


def test_ply_with_java_exponents(spark, put):
    path = put("c.ply", "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1.5 -2.0 1250.0\n-0.0 7.105427357601002E-15 3\n\n10 20 30\n")
    assert [tuple(r)[1:] for r in readers.read_ply(spark, path).orderBy("point_id").collect()] == [(0, 1.5, -2.0, 1250.0), (1, 0.0, 7.105427357601002e-15, 3.0), (3, 10.0, 20.0, 30.0)]


def test_dxf_lines_among_others(spark, put):
    line = lambda x1, y1, x2, y2: f"0\nLINE\n8\nBORDES\n10\n{x1}\n20\n{y1}\n11\n{x2}\n21\n{y2}\n"
    text = "0\nSECTION\n2\nHEADER\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n" + line(35, 96, 38, 96) + "0\nCIRCLE\n8\nBORDES\n10\n1\n20\n2\n40\n3\n" + line(1.5, 26, 9, 26) + "0\nENDSEC\n0\nEOF"
    got = readers.read_dxf(spark, put("d.dxf", text)).orderBy("entity_id").collect()
    assert [(r.layer, r.x1, r.y1, r.x2, r.y2) for r in got] == [("BORDES", 35.0, 96.0, 38.0, 96.0), ("BORDES", 1.5, 26.0, 9.0, 26.0)]


def test_vocabulary_report(spark, put):
    got = readers.read_vocabulary(spark, put("v.txt", "assembly=PULLEY conf=0.9412\nshapes=14 relations=10\nCYLINDER 0.98 outer shell\nSHAFT 0.97 axis\n")).orderBy("rank").collect()
    assert [(r.assembly, r.assembly_confidence, r.shapes, r.relations, r["rank"], r["class"], r.confidence, r.reason) for r in got] == [("PULLEY", 0.9412, 14, 10, 1, "CYLINDER", 0.98, "outer shell"), ("PULLEY", 0.9412, 14, 10, 2, "SHAFT", 0.97, "axis")]


def test_photos_and_inertial_samples(spark, tmp_path, put):
    for session, n in (("s1", 2), ("s2", 1)):
        (tmp_path / "photos" / session).mkdir(parents=True)
        for k in range(n):
            (tmp_path / "photos" / session / f"{k}.jpg").write_bytes(b"x" * (k + 1))
    got = readers.read_photos(spark, str(tmp_path / "photos" / "*")).groupBy("session_id").count().collect()
    assert {tuple(r) for r in got} == {("s1", 2), ("s2", 1)}
    sample = {"session_id": 4, "ts": "2024-01-01T00:00:00.250Z", "gx": 0.1, "az": -9.5, "qw": 1.0}
    path = put("imu.json", json.dumps(sample) + "\n" + json.dumps(sample | {"gx": 0.2}))
    rows = readers.read_imu(spark, path).orderBy("gx").collect()
    assert [(r.session_id, r.gx, r.az, r.gy) for r in rows] == [(4, 0.1, -9.5, None), (4, 0.2, -9.5, None)] and rows[0].t % 1 == 0.25
    assert readers.read_imu(spark, path.rsplit("/", 1)[0], stream=True).isStreaming
