from __future__ import annotations

import json
import math
import zlib

import pytest

import terrafold.queries  # noqa: F401
from terrafold.engine.graph import Context, GraphError, from_json
from terrafold.model.descriptor import Band, GeoTransform, RasterDescriptor, VectorDescriptor
from terrafold.model.rect import Rect
from terrafold.plans.optimizer import best_overview, for_request, optimize
from terrafold.plots.terminal import BoxPlot
from terrafold.queries import op, over
from terrafold.sinks.outputs import Colorizer, feature_collection, png, store, tiles

DATA = op("MockFeatureCollectionSource", geometryType="Data", columns={"v": "float", "k": "text"}, rows=[[i, i + 1, float(v) if v is not None else None, k] for i, (v, k) in enumerate([(1, "a"), (2, "a"), (4, "b"), (8, ""), (None, None)])])


@pytest.fixture
def ctx(spark):
    pixels = spark.createDataFrame([(0, 10, 0, y, x, y * 8 + x) for y in range(8) for x in range(8)], "t_start long, t_end long, band int, y int, x int, value int")
    return Context(spark, {"r": (pixels, RasterDescriptor("I32", GeoTransform(0, 8, 1, -1), (0, 7, 0, 7), (Band("a"),)))})


def test_statistics(ctx):
    doc = from_json(op("Statistics", {"source": DATA}, columnNames=["v"])).document(ctx, Rect())["v"]
    assert (doc["valueCount"], doc["validCount"], doc["min"], doc["max"], doc["mean"]) == (5, 4, 1.0, 8.0, 3.75)
    one = op("MockFeatureCollectionSource", geometryType="Data", columns={"v": "float"}, rows=[[0, 1, 3.0]])
    assert math.isnan(from_json(op("Statistics", {"source": one})).document(ctx, Rect())["v"]["stddev"])


def test_histogram_documents(ctx):
    doc = from_json(op("Histogram", {"source": DATA}, attributeName="v", buckets={"type": "number", "value": 2})).document(ctx, Rect())
    assert [v["Frequency"] for v in doc["data"]["values"]] == [3, 1] and doc["usermeta"]["nodataCount"] == 1
    empty = op("MockFeatureCollectionSource", geometryType="Data", columns={"v": "float"}, rows=[])
    assert len(from_json(op("Histogram", {"source": empty}, attributeName="v")).document(ctx, Rect())["data"]["values"]) == 1


def test_box_plot_leaves_out_the_median(ctx):
    rows = op("MockFeatureCollectionSource", geometryType="Data", columns={"v": "float"}, rows=[[0, 1, float(v)] for v in (1, 2, 3, 4, 5)])
    doc = from_json(op("BoxPlot", {"source": rows})).document(ctx, Rect())
    assert [(r["q1"], r["median"], r["q3"]) for r in [{k: v for k, v in r.items()} for r in doc["data"]["values"]]] == [(1.5, 3.0, 4.5)]


@pytest.mark.parametrize("most", [10_000, 3])
def test_box_plots_of_many_values_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(BoxPlot, "SORTED", most)
    n = 12_346
    columns = {
        "spread": [math.sin(i) * 10.0 ** (i % 40 - 20) for i in range(n)],
        "ties": [0.0 if i % 4 == 0 else 1.5 if i % 4 < 3 else 7.0 for i in range(n)],
        "gap": [None if i % 3 == 0 else math.inf if i % 3 == 1 and i > 12_000 else -(1.7e308 - i * 1e300) if i % 2 else 1.7e308 - i * 1e300 for i in range(n)],
        "few": [float(i) if i < 2 else math.nan for i in range(n)],
        "none": [None] * n,
    }
    rows = spark.createDataFrame(list(zip([0] * n, [1] * n, *columns.values(), strict=True)), "t_start long, t_end long, " + ", ".join(f"{c} double" for c in columns))
    ctx = Context(spark, {"many": (rows, VectorDescriptor("Data", dict.fromkeys(columns, "float")))})
    got = {r.name: tuple(r)[1:] for r in from_json(op("BoxPlot", {"source": op("MockDatasetDataSource", data="many")})).query(ctx, Rect()).collect()}

    def median(s):
        a, b = s[(len(s) - 1) // 2], s[len(s) // 2]
        return (a + b) / 2 if math.isfinite(a + b) else a / 2 + b / 2

    for c, values in columns.items():
        s = sorted(v for v in values if v is not None and math.isfinite(v))
        half = len(s) // 2
        assert got.get(c) == ((s[0], median(s[:half]), median(s), median(s[-half:]), s[-1], True) if s else None)


def test_pie_and_errors(ctx):
    doc = from_json(op("PieChart", {"vector": DATA}, columnName="k")).document(ctx, Rect())
    assert doc["data"]["values"] == [{"slice": "a", "value": 2}, {"slice": "b", "value": 1}]
    with pytest.raises(GraphError):
        from_json(op("Histogram", {"source": DATA}, attributeName="k")).describe(ctx)
    many = op("MockFeatureCollectionSource", geometryType="Data", columns={"k": "text"}, rows=[[0, 1, str(i)] for i in range(40)])
    with pytest.raises(GraphError):
        from_json(op("PieChart", {"vector": many}, columnName="k")).document(ctx, Rect())


@pytest.mark.parametrize("kind", ["ScatterPlot", "FeatureAttributeValuesOverTime", "MeanRasterPixelValuesOverTime"])
def test_other_documents(ctx, kind):
    graph = {
        "ScatterPlot": op("ScatterPlot", {"vector": DATA}, columnX="v", columnY="v"),
        "FeatureAttributeValuesOverTime": op("FeatureAttributeValuesOverTime", {"vector": DATA}, idColumn="k", valueColumn="v"),
        "MeanRasterPixelValuesOverTime": op("MeanRasterPixelValuesOverTime", {"raster": op("GdalSource", data="r")}),
    }[kind]
    assert json.dumps(from_json(graph).document(ctx, Rect()))


def test_geojson(ctx):
    points = op("MockFeatureCollectionSource", geometryType="MultiPoint", columns={"n": "int"}, rows=[[0, 1000, [[1.0, 2.0]], None]])
    doc = json.loads(feature_collection(from_json(points).query(ctx, Rect()), "MultiPoint"))["features"][0]
    assert doc["geometry"] == {"type": "MultiPoint", "coordinates": [[1.0, 2.0]]} and doc["properties"] == {"n": None}
    assert doc["when"]["start"].startswith("1970-01-01T00:00:00.000") and doc["when"]["end"].startswith("1970-01-01T00:00:01.000")


def test_png_and_tiles(ctx, tmp_path):
    node = from_json(op("GdalSource", data="r"))
    image = png(node.query(ctx, Rect()), Colorizer("linear", ((0, (0, 0, 0, 255)), (63, (63, 126, 0, 255)))), (0, 7, 0, 7))
    raw = zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])
    assert image[:4] == b"\x89PNG" and len(raw) == 8 * (1 + 8 * 4) and raw[-4:] == bytes([63, 126, 0, 255])
    rows = tiles(node.query(ctx, Rect()), 4).collect()
    assert len(rows) == 4 and all(len(r.data) == 16 for r in rows)
    store(node.query(ctx, Rect()), node.describe(ctx), str(tmp_path / "out"))
    assert ctx.spark.read.parquet(str(tmp_path / "out/data")).count() == 64


def test_optimizer_reads_overviews(ctx):
    source = op("GdalSource", data="r")
    best = optimize(from_json(over("BandwiseExpression", source, expression="x + 1")), (4.0, 4.0), ctx)
    assert best.to_json()["sources"]["raster"]["params"]["overviewLevel"] == 4
    assert optimize(from_json(over("Interpolation", source, outputResolution={"type": "fraction", "x": 2, "y": 2})), (1.0, 1.0), ctx).TYPE == "GdalSource"
    shrunk = optimize(from_json(over("Downsampling", source, outputResolution={"type": "resolution", "x": 2, "y": 2})), (4.0, 4.0), ctx)
    assert shrunk.to_json() == op("GdalSource", data="r", overviewLevel=4, fillGaps=True)
    assert best_overview(1.0, 7.9) == 4
    for target in ((0.5, 0.5), (1.5, 1.5)):
        with pytest.raises(GraphError):
            optimize(from_json(source), target, ctx)
    with pytest.raises(GraphError):
        optimize(from_json(op("GdalSource", data="r", overviewLevel=2)), (4.0, 4.0), ctx)
    assert for_request(from_json(source), "EPSG:4326", (3.0, 3.0), ctx).TYPE == "Downsampling"
    assert for_request(from_json(source), "EPSG:4326", (0.5, 0.5), ctx).TYPE == "Interpolation"


def test_geotiff(ctx):
    import struct

    from terrafold.sinks.outputs import geotiff

    node = from_json(op("GdalSource", data="r"))
    raw = geotiff(node.query(ctx, Rect()), node.describe(ctx), (0, 7, 0, 7), -1)
    at = struct.unpack("<I", raw[4:8])[0]
    tags = {t: v for t, _, _, v in struct.iter_unpack("<HHII", raw[at + 2 : at + 2 + 12 * struct.unpack("<H", raw[at : at + 2])[0]])}
    assert raw[:4] == b"II*\0" and (tags[256], tags[257], tags[273]) == (8, 8, 8)
    assert struct.unpack("<64i", raw[8 : 8 + 256]) == tuple(range(64))


def test_cache(ctx):
    from terrafold.engine.cache import QueryCache, contains

    assert contains(Rect(), Rect(pixels=(0, 1, 0, 1))) and not contains(Rect(pixels=(0, 1, 0, 1)), Rect())
    cache, node = QueryCache(ctx, most=2), from_json(op("GdalSource", data="r"))
    assert cache.query(node, Rect()).count() == 64
    assert cache.query(node, Rect(pixels=(0, 1, 0, 3))).count() == 8 and (cache.hits, cache.misses) == (1, 1)
    summed = from_json(over("TemporalRasterAggregation", op("GdalSource", data="r"), aggregation={"type": "sum"}, window={"granularity": "millis", "step": 10}))
    cache.query(summed, Rect(time=(0, 20)))
    assert cache.query(summed, Rect(time=(0, 10))).count() == 64 and cache.misses == 3
