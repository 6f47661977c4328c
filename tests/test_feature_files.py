from __future__ import annotations

import json
import sqlite3
import struct

import pytest

import terrafold.queries  # noqa: F401  registers all operators
from terrafold.builder import build
from terrafold.engine.graph import Context, GraphError
from terrafold.model.descriptor import VectorDescriptor
from terrafold.model.rect import Rect
from terrafold.sinks.outputs import feature_collection
from terrafold.sources.features import from_wkb, parse_wkb, read_geojson, read_geopackage

RING = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 0.5], [2.0, 0.5], [2.0, 1.0], [1.0, 0.5]]
COORDINATES = {
    "Point": [1.5, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": [[0.0, 0.0], [1.0, 5.0]], "MultiLineString": [[[0.0, 0.0], [1.0, 5.0]], [[2.0, 2.0], [3.0, 3.0], [4.0, 1.0]]],
    "Polygon": [RING, HOLE], "MultiPolygon": [[RING, HOLE], [RING]],
}
KINDS = ["MultiPoint", "MultiLineString", "MultiPolygon"]


def plain(geom):
    """Rows of points as lists of numbers."""
    return None if geom is None else [plain(g) if isinstance(g, list) else [g.x, g.y] for g in geom]


def multi(kind):
    own = COORDINATES[kind]
    return own if kind.startswith("Multi") else [own]


def wkb(kind, c, order="<", height=0):
    codes = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
    head = struct.pack(order + "BI", order == "<", codes[kind] + {0: 0, 1: 1000, 2: 0x80000000}[height])
    point = lambda p: struct.pack(f"{order}{3 if height else 2}d", *p, *([9.0] if height else []))
    run = lambda ps: struct.pack(order + "I", len(ps)) + b"".join(map(point, ps))
    if kind == "Point":
        return head + point(c)
    if kind == "LineString":
        return head + run(c)
    if kind == "Polygon":
        return head + struct.pack(order + "I", len(c)) + b"".join(map(run, c))
    return head + struct.pack(order + "I", len(c)) + b"".join(wkb(kind.removeprefix("Multi"), p, order, height) for p in c)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("height", [0, 1, 2])
def test_well_known_binary(spark, order, height):
    for kind, c in COORDINATES.items():
        raw = wkb(kind, c, order, height)
        found, points, end = parse_wkb(raw)
        assert found == kind and end == len(raw) and json.loads(json.dumps(points)) == c
    with pytest.raises(GraphError):
        parse_wkb(struct.pack("<BI", 1, 7))


def test_binary_column(spark):
    df = spark.createDataFrame([(k, wkb(k, c)) for k, c in COORDINATES.items()] + [("none", None)], "k string, raw binary")
    for kind in KINDS:
        got = {r.k: plain(r.geom) for r in df.select("k", from_wkb(df.raw, kind).alias("geom")).collect()}
        assert got == {k: multi(k) if k in COORDINATES and k.removeprefix("Multi") == kind.removeprefix("Multi") else None for k in [*COORDINATES, "none"]}


def features():
    out = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"foo": i + 0.5, "bar": f"b{i}", "flag": i % 2 == 0}} for i, (k, c) in enumerate(COORDINATES.items())]
    out.append({"type": "Feature", "geometry": None, "properties": {"foo": None, "bar": "none"}})
    out.append({"type": "Feature", "geometry": {"type": "Point", "coordinates": [7, 8, 99]}, "properties": {"foo": 1, "bar": None}, "when": {"start": "2014-01-01T00:00:00Z", "end": "2014-02-01T00:00:00Z", "type": "Interval"}})
    return out


@pytest.mark.parametrize("form", ["document", "lines", "sequence", "one"])
def test_geojson(spark, tmp_path, form):
    own = features()
    path = tmp_path / "f.json"
    if form == "document":
        path.write_text("\ufeff" + json.dumps({"type": "FeatureCollection", "features": own}, indent=1))
    elif form == "one":
        own = own[:1]
        path.write_text(json.dumps(own[0]))
    else:
        path.write_text("\n".join({"lines": "", "sequence": "\x1e"}[form] + json.dumps(f) for f in own) + "\n\n")
    for kind in KINDS:
        rows = read_geojson(spark, [str(path)], kind, ("foo", "bar", "flag", "absent"), lines=form in ("lines", "sequence")).collect()
        assert len(rows) == len(own) and all(r.absent is None for r in rows)
        for f, r in zip(own, rows, strict=True):
            shape = f["geometry"]
            fits = shape is not None and shape["type"].removeprefix("Multi") == kind.removeprefix("Multi")
            want = (shape["coordinates"] if shape["type"] == kind else [shape["coordinates"]]) if fits else None
            assert plain(r.geom) == ([[7.0, 8.0]] if want == [[7, 8, 99]] else want)
            assert r.bar == f["properties"]["bar"] and (r.foo is None or float(r.foo) == f["properties"]["foo"])


def test_source_of_geojson(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features()}))
    df = read_geojson(spark, [str(tmp_path / "f.json")], "MultiPoint", ("foo", "bar"))
    spec = {"geometry": {"name": "geom", "type": "MultiPoint"}, "float": ["foo"], "text": ["bar"]}
    time = {"kind": "startEnd", "start": "when_start", "end": "when_end"}
    ctx = Context(spark, {"f": (df, VectorDescriptor("MultiPoint"))})
    node = build.OgrSource(data="f", columns=spec, time=time).operator()
    assert node.describe(ctx) == VectorDescriptor("MultiPoint", {"foo": "float", "bar": "text"})
    got = sorted((plain(r.geom), r.foo, r.bar) for r in node.query(ctx, Rect(bbox=(0, 0, 5, 5))).collect())
    assert got == [([[1.0, 2.0], [3.0, 4.0]], 1.5, "b1"), ([[1.5, 2.0]], 0.5, "b0")]
    (dated,) = node.query(ctx, Rect(bbox=(6, 6, 9, 9))).collect()
    assert (dated.t_start, dated.t_end, dated.bar) == (1_388_534_400_000, 1_391_212_800_000, None)
    with pytest.raises(Exception, match="no geometry"):
        build.OgrSource(data="f", columns=spec, onError="abort").operator().query(ctx, Rect()).collect()
    with pytest.raises(GraphError):
        build.OgrSource(data="f", columns={"geometry": {"type": "Blob"}}).operator().describe(ctx)


def test_geojson_that_was_written(spark, tmp_path):
    df = spark.createDataFrame([(0, 10, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]], 1, "a")], "t_start long, t_end long, geom array<array<array<struct<x:double,y:double>>>>, n long, name string")
    (tmp_path / "f.json").write_text(feature_collection(df, "MultiPolygon"))
    (back,) = read_geojson(spark, [str(tmp_path / "f.json")], "MultiPolygon", ("n", "name")).collect()
    assert (plain(back.geom), back.n, back.name) == ([[RING]], "1", "a") and back.when_start.startswith("1970-01-01T00:00:00")


def test_geopackage(spark, tmp_path):
    for k in range(2):
        db = sqlite3.connect(tmp_path / f"{k}.gpkg")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('towns', 'shape')")
        db.execute('CREATE TABLE towns (fid INTEGER, shape BLOB, "the name" TEXT, size REAL)')
        for i, (kind, c) in enumerate(COORDINATES.items()):
            bounds = [b"", struct.pack("<4d", 0, 0, 1, 1)][i % 2]
            db.execute("INSERT INTO towns VALUES (?, ?, ?, ?)", (i, b"GP" + bytes([0, 1 | (i % 2) << 1]) + struct.pack("<i", 4326) + bounds + wkb(kind, c), f"t{k}", i / 4))
        db.execute("INSERT INTO towns VALUES (9, ?, NULL, NULL)", (b"GP" + bytes([0, 0x11]) + struct.pack("<i", 4326) + wkb("Point", [float("nan")] * 2),))
        db.execute("INSERT INTO towns VALUES (10, NULL, 'no place', 1)")
        db.commit()
        db.close()
    paths = [str(tmp_path / f"{k}.gpkg") for k in range(2)]
    for kind in KINDS:
        rows = read_geopackage(spark, paths, "towns", kind, ("fid", "the name", "size")).collect()
        assert len(rows) == 2 * 8
        for r in rows:
            name = dict(enumerate(COORDINATES)).get(int(r.fid))
            assert plain(r.geom) == (multi(name) if name and name.removeprefix("Multi") == kind.removeprefix("Multi") else None)
        assert {r["the name"] for r in rows} == {"t0", "t1", None, "no place"} and {r.size for r in rows if r.fid == "3"} == {"0.75"}
    with pytest.raises(Exception, match="no layer"):
        read_geopackage(spark, paths, "rivers", "MultiPoint").collect()
    with pytest.raises(GraphError):
        read_geopackage(spark, paths, "towns", "Blob")
