from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest

import terrafold.queries  # noqa: F401  registers all operators
from terrafold.builder import build
from terrafold.engine.graph import Context, GraphError, from_json
from terrafold.functions import projection
from terrafold.model.descriptor import Band, GeoTransform, RasterDescriptor, VectorDescriptor
from terrafold.model.rect import Rect
from terrafold.model.time import TimeStep
from terrafold.operators.ml import Model, onnx_linear
from terrafold.operators.simplify import crosses, visvalingam
from terrafold.sinks.outputs import geotiffs, rgb_png
from terrafold.sources.geotiff import Image, descriptor, read_geotiffs, regular_files

GRID = GeoTransform(10.0, 50.0, 0.5, -0.5)
DESC = RasterDescriptor("I16", GRID, (0, 5, 0, 7), (Band("a"), Band("b")), time=(0, 20))


def pixels(spark):
    rows = [(t, t + 10, band, y, x, None if (x + y) % 5 == 0 else t + 100 * band + 10 * y - x) for t in (0, 10) for band in (0, 1) for y in range(6) for x in range(8)]
    return spark.createDataFrame(rows, "t_start long, t_end long, band int, y int, x int, value int"), rows


def test_geotiffs_by_slice_and_square_read_back(spark, tmp_path):
    df, rows = pixels(spark)
    files = geotiffs(df, DESC, DESC.pixels, -9999, size=4).collect()
    assert len(files) == 2 * 2 * 2
    listed = []
    for f in files:
        path = tmp_path / f"{f.t_start}-{f.y}-{f.x}.tif"
        path.write_bytes(f.content)
        listed.append((f"file://{path}", f.t_start, f.t_end, 0))
    assert descriptor(bytes(files[0].content)).srs == "EPSG:4326" and descriptor(bytes(files[0].content)).data_type == "I16"
    back = read_geotiffs(spark, listed, DESC)
    assert sorted(map(str, (tuple(r)[:6] for r in back.collect()))) == sorted(str(r) for r in rows)
    ctx = Context(spark, {"tif": (back, DESC)}, slices={"tif": [(0, 10), (10, 20), (20, 30)]})
    mosaic = build.MultiBandGdalSource(data="tif").operator().query(ctx, Rect())
    assert mosaic.count() == 3 * 2 * 48 and mosaic.where("value is not null").count() == sum(r[-1] is not None for r in rows)
    own = []
    for k, f in enumerate(files[:2]):  # files of one name in two folders
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "same name.tif").write_bytes(f.content)
        own.append((str(tmp_path / f"{k}" / "same name.tif"), k, k + 1, k))
    by_file = {r.t_start: r["count"] for r in read_geotiffs(spark, own, DESC).groupBy("t_start").count().collect()}
    assert by_file == {k: len(Image.parse(bytes(f.content)).rows(0, Image.parse(bytes(f.content)).shape[1]).ravel()) for k, f in enumerate(files[:2])}
    with pytest.raises(Exception, match="grid"):
        read_geotiffs(spark, listed[:1], DESC.but(transform=GeoTransform(10.1, 50.0, 0.5, -0.5))).collect()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tiled", [False, True])
def test_layouts_of_tiff(order, tiled):
    """Bands side by side, deflated, with differences along rows, in strips or tiles."""
    data = np.random.default_rng(1).integers(0, 60_000, (5, 7, 2)).astype(order + "u2")
    tall, wide = (4, 4) if tiled else (2, 7)
    pieces = []
    for r in range(0, 5, tall):
        for c in range(0, 7, wide):
            part = np.zeros((tall if tiled else min(tall, 5 - r), wide, 2), data.dtype)
            own = data[r : r + tall, c : c + wide]
            part[: own.shape[0], : own.shape[1]] = own
            part[:, 1:] -= part[:, :-1].copy()
            pieces.append(zlib.compress(part.tobytes()))
    at, offsets = 8, []
    for p in pieces:
        offsets.append(at)
        at += len(p)
    tags = [(256, "I", [7]), (257, "I", [5]), (258, "H", [16, 16]), (259, "H", [8]), (277, "H", [2]), (284, "H", [1]), (317, "H", [2]), (339, "H", [1, 1])]
    tags += [(322, "I", [4]), (323, "I", [4]), (324, "I", offsets), (325, "I", list(map(len, pieces)))] if tiled else [(273, "I", offsets), (278, "I", [2]), (279, "I", list(map(len, pieces)))]
    entries, extra = b"", b""
    start = at + 2 + 12 * len(tags) + 4
    for tag, form, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        place = struct.pack(order + "I", start + len(extra)) if len(raw) > 4 else raw.ljust(4, b"\0")
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[form], len(values)) + place
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)
    image = Image.parse(head + b"".join(pieces) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + extra)
    assert (np.moveaxis(image.rows(0, 5), 0, 2) == data).all() and (np.moveaxis(image.rows(1, 4), 0, 2) == data[1:4]).all()


def test_rgb_png(spark):
    df = spark.createDataFrame([(b, 0, x, v) for b in range(3) for x, v in ((0, 10 * b), (1, 20))] + [(0, 0, 2, 5)], "band int, y int, x int, value int")
    raw = rgb_png(df, (0, 0, 0, 2), 0, 20)
    data = zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])
    assert list(data) == [0, 0, 128, 255, 255, 255, 255, 255, 255, 0, 0, 0, 0]


def test_utm_against_known_places_and_back():
    # the meridian's arc from the equator to 45 degrees is 4 984 944.378 m on this ellipsoid
    x, y = projection.project_number("EPSG:4326", "EPSG:32632", 9.0, 45.0)
    assert x == pytest.approx(500_000, abs=1e-6) and y == pytest.approx(0.9996 * 4_984_944.378, abs=1e-3)
    assert projection.project_number("EPSG:4326", "EPSG:32732", 9.0, -45.0)[1] == pytest.approx(10_000_000 - 0.9996 * 4_984_944.378, abs=1e-3)
    for lon, lat in ((6.1, 1.0), (9.0, 50.0), (11.9, 83.0), (7.5, -33.0)):
        there = projection.project_number("EPSG:4326", "EPSG:32632", lon, lat)
        assert projection.project_number("EPSG:32632", "EPSG:4326", *there) == pytest.approx((lon, lat), abs=1e-9)
    assert projection.project_box("EPSG:4326", "EPSG:32632", (30.0, 0.0, 40.0, 10.0)) is None
    with pytest.raises(projection.ProjectionError):
        projection.check("EPSG:4326", "EPSG:32661")


def test_files_of_a_regular_dataset():
    month, jan, apr = TimeStep("months", 1), 1_388_534_400_000, 1_396_310_400_000
    files = regular_files("/d/%_START_%_%_END_%.tif", (jan, apr), month, {"%_START_%": ("start", "%Y-%m-%d"), "%_END_%": ("end", "%Y%m")})
    assert [f[0] for f in files] == ["/d/2014-01-01_201402.tif", "/d/2014-02-01_201403.tif", "/d/2014-03-01_201404.tif"]
    assert files[0][1] == jan and files[-1][2] == apr
    with pytest.raises(GraphError):
        regular_files("/d/a.tif", (jan, apr), month, {"%_START_%": ("start", "%Y")})


def test_geostationary_against_known_places_and_back(spark):
    to, back = (lambda *p: projection.project_number("EPSG:4326", "SR-ORG:81", *p)), (lambda *p: projection.project_number("SR-ORG:81", "EPSG:4326", *p))
    assert to(0.0, 0.0) == (0.0, 0.0)
    assert to(2.0, 1.0) == pytest.approx((222527.0704, 110551.3034), abs=0.01)
    for p in ((70.0, 10.0), (-30.5, 65.0), (8.8, 50.8), (0.0, -79.0)):
        assert back(*to(*p)) == pytest.approx(p, abs=1e-7)
    assert all(map(math.isnan, to(100.0, 0.0) + to(0.0, 89.0) + back(5_500_000.0, 5_500_000.0)))
    assert projection.project_box("EPSG:4326", "SR-ORG:81", (-180.0, -90.0, 180.0, 90.0)) == (-5_568_748.276, -5_568_748.276, 5_568_748.276, 5_568_748.276)
    assert projection.project_box("EPSG:4326", "SR-ORG:81", (100.0, 0.0, 120.0, 10.0)) is None
    places = [(2.0, 1.0), (100.0, 0.0), (-30.5, 65.0)]
    df = spark.createDataFrame([(0, 1, [p], k) for k, p in enumerate(places)], "t_start long, t_end long, geom array<struct<x:double,y:double>>, k int")
    ctx = Context(spark, {"p": (df, VectorDescriptor("MultiPoint", {"k": "int"}))})
    got = {r.k: (r.geom[0].x, r.geom[0].y) for r in build.MockDatasetDataSource(data="p").Reprojection(targetSpatialReference="SR-ORG:81").operator().query(ctx, Rect()).collect()}
    assert set(got) == {0, 2} and all(got[k] == pytest.approx(to(*places[k]), abs=1e-6) for k in got)


@pytest.mark.parametrize(("here", "there", "transform", "pixels"), [
    ("EPSG:4326", "SR-ORG:81", GeoTransform(-180.0, 90.0, 15.0, -15.0), (0, 11, 0, 23)),
    ("SR-ORG:81", "EPSG:4326", GeoTransform(-5_568_748.0, 5_568_748.0, 464_062.0, -464_062.0), (0, 23, 0, 23)),
    ("EPSG:4326", "EPSG:32632", GeoTransform(7.0, 52.0, 0.25, -0.25), (0, 7, 0, 7)),
    ("EPSG:3857", "EPSG:4326", GeoTransform(-2e6, 2e7, 1e6, -1e6), (0, 3, 0, 3)),
])
@pytest.mark.parametrize("known", [True, False])
def test_reprojected_rasters_have_every_pixel(spark, here, there, transform, pixels, known):
    """Pixels without a source pixel are rows without value, in each band and slice, and also beyond the source."""
    a, b, c, d = pixels
    desc = RasterDescriptor("I32", transform, pixels, (Band("a"), Band("b")), srs=here, time=(0, 20))
    df = spark.createDataFrame([(t, t + 10, band, y, x, 1000 * y + x + t + band) for t in (0, 10) for band in (0, 1) for y in range(a, b + 1) for x in range(c, d + 1)], "t_start long, t_end long, band int, y int, x int, value int")
    node = build.GdalSource(data="r").Reprojection(targetSpatialReference=there).operator()
    ctx = Context(spark, {"r": (df, desc)}, slices={"r": [(0, 10), (10, 20)]} if known else {})
    own = node.describe(ctx)
    top, bottom, left, right = own.pixels
    for rect in (Rect(), Rect(pixels=(top - 2, bottom, left, right + 1), bands=(1,), time=(10, 15))):
        p, q, r, s = rect.pixels or own.pixels
        want = {}
        for y in range(p, q + 1):
            for x in range(r, s + 1):
                px, py = projection.project_number(there, here, *own.transform.centre(y, x))
                row, col = desc.transform.pixel(px, py) if math.isfinite(px) and math.isfinite(py) else (-1, -1)
                if here == "EPSG:3857" and abs(own.transform.centre(y, x)[1]) > 85.06:
                    row = -1
                for t in (0, 10):
                    for band in (0, 1):
                        if rect.bands is None or (band, t) == (1, 10):
                            want[t, band, y, x] = 1000 * row + col + t + band if a <= row <= b and c <= col <= d else None
        rows = node.query(ctx, rect).collect()
        assert {(k.t_start, k.band, k.y, k.x): k.value for k in rows} == want and len(rows) == len(want)
        assert any(v is not None for v in want.values())


def test_pixels_in_utm(spark):
    """Each target pixel has the source pixel under its centre, or no value."""
    desc = RasterDescriptor("I32", GeoTransform(6.0, 52.0, 0.25, -0.25), (0, 15, 0, 23), (Band("a"),), time=(0, 10))
    df = spark.createDataFrame([(0, 10, 0, y, x, 100 * y + x) for y in range(16) for x in range(24)], "t_start long, t_end long, band int, y int, x int, value int")
    node = build.GdalSource(data="r").Reprojection(targetSpatialReference="EPSG:32632").operator()
    ctx = Context(spark, {"r": (df, desc)}, slices={"r": [(0, 10)]})
    own = node.describe(ctx)
    got = {(r.y, r.x): r.value for r in node.query(ctx, Rect()).collect()}
    want = {}
    for y in range(own.pixels[0], own.pixels[1] + 1):
        for x in range(own.pixels[2], own.pixels[3] + 1):
            row, col = desc.transform.pixel(*projection.project_number("EPSG:32632", "EPSG:4326", *own.transform.centre(y, x)))
            if 0 <= row <= 15 and 0 <= col <= 23:
                want[y, x] = 100 * row + col
    assert {k: v for k, v in got.items() if v is not None} == want and len(want) > 300
    assert len(got) == (own.pixels[1] - own.pixels[0] + 1) * (own.pixels[3] - own.pixels[2] + 1)


def test_onnx_file_by_path(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(onnx_linear((2.0, -1.0), 0.5))
    df, rows = pixels(spark)
    desc = DESC.but(data_type="F32")
    ctx = Context(spark, {"r": (df, desc)}, models={"m": Model(f"file://{tmp_path}/m.onnx", 2)}, slices={"r": [(0, 10), (10, 20)]})
    got = {(r.t_start, r.y, r.x): r.value for r in build.GdalSource(data="r").Onnx(model="m").operator().query(ctx, Rect()).collect()}
    by = {(r[0], r[2], r[3], r[4]): r[5] for r in rows}
    assert all(v == (None if by[t, 0, y, x] is None else 2.0 * by[t, 0, y, x] - by[t, 1, y, x] + 0.5) for (t, y, x), v in got.items()) and len(got) == 96


def test_builder():
    graph = build.GdalSource(data="r").BandFilter(bands=["a"]).TimeShift(kind="relative", granularity="days", value=1)
    assert graph.spec["sources"]["source"]["sources"]["raster"]["params"] == {"data": "r"}
    assert from_json(graph.to_json()) == graph.operator()
    join = build.MockPointSource(points=[[1, 2]]).RasterVectorJoin(rasters=[graph], featureAggregation="first")
    assert join.operator().rasters[0] == graph.operator()
    with pytest.raises(GraphError):
        build.GdalSource(colour="red")
    with pytest.raises(AttributeError):
        build.Nothing()


def test_simplified_lines_do_not_cross_themselves():
    r = np.random.default_rng(3)
    for _ in range(20):
        angle = np.linspace(0, 2 * math.pi, 80)
        ring = np.column_stack([np.cos(angle), np.sin(angle)]) * (1 + 0.4 * r.random(80))[:, None]
        ring[-1] = ring[0]
        for epsilon in (0.01, 0.2, 5.0):
            own = visvalingam(ring, epsilon, 4)
            for i in range(len(own) - 1):
                others = [k for k in range(len(own) - 1) if abs(k - i) > 1 and {k, i} != {0, len(own) - 2}]
                assert not crosses(own[i], own[i + 1], own[others], own[[k + 1 for k in others]])
    spiral = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 1], [3, 1], [3, 3], [1, 3], [1, 2], [2, 2]], float)
    assert len(visvalingam(spiral, 100.0, 2)) >= 2


def plain_visvalingam(points, epsilon, least):
    """The same rule without a heap or a grid: every step looks at all points and all segments."""
    own, tried = [tuple(p) for p in points], {}
    ids = list(range(len(own)))
    while len(ids) > least:
        rank = []
        for k in range(1, len(ids) - 1):
            (ax, ay), (bx, by), (cx, cy) = (own[ids[j]] for j in (k - 1, k, k + 1))
            area = abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2
            if area <= epsilon and tried.get(ids[k]) != (ids[k - 1], ids[k + 1]):
                rank.append((area, ids[k], k))
        if not rank:
            break
        _, i, k = min(rank)
        others = [j for j in range(len(ids) - 1) if j not in (k - 2, k - 1, k, k + 1)]
        if own[ids[0]] == own[ids[-1]]:
            others = [j for j in others if not (j == 0 and k + 1 == len(ids) - 1) and not (j == len(ids) - 2 and k == 1)]
        at = lambda js: np.array([own[ids[j]] for j in js], float).reshape(-1, 2)
        if crosses(np.array(own[ids[k - 1]]), np.array(own[ids[k + 1]]), at(others), at([j + 1 for j in others])):
            tried[i] = (ids[k - 1], ids[k + 1])
        else:
            del ids[k]
    return np.array([own[i] for i in ids])


@pytest.mark.parametrize("few", [0, 2, 64])
def test_visvalingam_against_brute_force(few, monkeypatch):
    from terrafold.operators import simplify

    monkeypatch.setattr(simplify, "FEW_CELLS", few)
    r = np.random.default_rng(few)
    for k in range(30):
        n = int(r.integers(5, 60))
        line = np.cumsum(r.normal(size=(n, 2)), axis=0) if k % 3 else np.column_stack([np.arange(n), r.integers(0, 3, n)]).astype(float)
        if k % 2:
            angle = np.sort(r.random(n)) * 2 * math.pi
            line = np.column_stack([np.cos(angle), np.sin(angle)]) * (1 + r.random(n))[:, None]
            line = np.vstack([line, line[:1]])
        for epsilon in (0.0, 0.05, 0.5, 50.0):
            assert np.array_equal(visvalingam(line, epsilon, 4), plain_visvalingam(line, epsilon, 4))
    assert len(visvalingam(np.zeros((9, 2)), 1.0, 4)) >= 4
