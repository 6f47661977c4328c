from __future__ import annotations

import math

import pytest

import terrafold.queries  # noqa: F401  registers all operators
from terrafold.engine.graph import REGISTRY, Context, GraphError, from_json
from terrafold.engine.workflow import Workflow
from terrafold.model.descriptor import Band, GeoTransform, RasterDescriptor
from terrafold.model.rect import Rect
from terrafold.operators.raster import band_names
from terrafold.operators.simplify import douglas_peucker, visvalingam
from terrafold.queries import over, op
from terrafold.sources.tables import MockRasterSource, fill_gaps
from terrafold.model.time import TimeStep

GRID = GeoTransform(0.0, 3.0, 1.0, -1.0)


def raster(*tiles, kind="U8", bands=("a",)):
    return MockRasterSource(tiles=tiles, descriptor=RasterDescriptor(kind, GRID, (0, 2, 0, 1), tuple(map(Band, bands))))


def tile(time, data, band=0):
    return {"time": time, "data": data, "band": band}


def grid(df, band=0):
    """{time: rows of values}"""
    out = {}
    for r in df.where(f"band = {band}").orderBy("t_start", "y", "x").collect():
        out.setdefault((r.t_start, r.t_end), {}).setdefault(r.y, []).append(r.value)
    return {t: list(rows.values()) for t, rows in out.items()}


UP, DOWN = [[1, 2], [3, 4], [5, 6]], [[6, 5], [4, 3], [2, 1]]
SERIES = [tile((0, 10), UP), tile((10, 20), DOWN), tile((20, 30), UP), tile((30, 40), [[None, 5], [4, 3], [2, 1]])]


@pytest.fixture
def ctx(spark):
    return Context(spark)


def make(kind, sources, **params):
    from terrafold.engine.graph import REGISTRY as known

    return known[kind](**sources, **params)


def test_every_operator_of_the_inventory_is_registered():
    expected = """GdalSource MultiBandGdalSource OgrSource CsvSource MockPointSource MockDatasetDataSource MockFeatureCollectionSource MockRasterSource ColumnRangeFilter BandFilter
    RasterTypeConversion RasterScaling Expression BandwiseExpression VectorExpression Reprojection LineSimplification TimeProjection TimeShift Radiance Reflectance Temperature VectorJoin
    PointInPolygonFilter RasterVectorJoin RasterStacker TemporalRasterAggregation NeighborhoodAggregate BandNeighborhoodAggregate Rasterization VisualPointClustering Interpolation Downsampling
    Onnx Statistics Histogram ClassHistogram PieChart BoxPlot ScatterPlot MeanRasterPixelValuesOverTime FeatureAttributeValuesOverTime""".split()
    assert set(expected) <= set(REGISTRY)


@pytest.mark.parametrize(
    ("name", "ignore", "first", "second"),
    [
        ("min", False, [[1, 2], [3, 3], [2, 1]], [[None, 2], [3, 3], [2, 1]]),
        ("max", True, [[6, 5], [4, 4], [5, 6]], [[1, 5], [4, 4], [5, 6]]),
        ("first", False, UP, UP),
        ("last", False, DOWN, [[None, 5], [4, 3], [2, 1]]),
        ("last", True, DOWN, [[1, 5], [4, 3], [2, 1]]),
        ("sum", True, [[7, 7]] * 3, [[1, 7], [7, 7], [7, 7]]),
        ("count", True, [[2, 2]] * 3, [[1, 2], [2, 2], [2, 2]]),
        ("mean", True, [[3, 3]] * 3, [[1, 3], [3, 3], [3, 3]]),
    ],
)
def test_temporal_aggregation(ctx, name, ignore, first, second):
    node = make("TemporalRasterAggregation", {"raster": raster(*SERIES)}, aggregation={"type": name, "ignoreNoData": ignore}, window=TimeStep("millis", 20))
    assert grid(node.query(ctx, Rect(time=(0, 40)))) == {(0, 20): first, (20, 40): second}


def test_sums_stay_in_range_and_windows_reach_beyond_the_query(ctx):
    node = make("TemporalRasterAggregation", {"raster": raster(tile((0, 10), [[200, 100]]), tile((10, 20), [[100, 100]]))}, aggregation={"type": "sum"}, window=TimeStep("millis", 15))
    assert grid(node.query(ctx, Rect(time=(12, 14)))) == {(0, 15): [[255, 200]]}


def test_neighborhood_needs_data_everywhere(ctx):
    node = make("NeighborhoodAggregate", {"raster": raster(tile((0, 1), UP), kind="I32")}, neighborhood={"type": "rectangle", "dimensions": (3, 1)}, aggregate_function="sum")
    assert grid(node.query(ctx, Rect())) == {(0, 1): [[None, None], [9, 12], [None, None]]}
    node = make("NeighborhoodAggregate", {"raster": raster(tile((0, 1), UP), kind="F64")}, neighborhood={"type": "rectangle", "dimensions": (1, 3)}, aggregate_function="standardDeviation")
    assert grid(node.query(ctx, Rect()))[0, 1][0] == [0.5, 0.5]
    with pytest.raises(GraphError):
        make("NeighborhoodAggregate", {"raster": raster()}, neighborhood={"type": "rectangle", "dimensions": (2, 3)}).describe(ctx)


def test_stacker_refines_times(ctx):
    node = make("RasterStacker", {"rasters": (raster(tile((0, 10), UP), tile((10, 20), DOWN)), raster(tile((5, 15), DOWN)))})
    assert [b.name for b in node.describe(ctx).bands] == ["a", "a (1)"]
    df = node.query(ctx, Rect())
    assert grid(df, 0) == {(5, 10): UP, (10, 15): DOWN}
    assert grid(df, 1) == {(5, 10): DOWN, (10, 15): DOWN}


def test_band_names():
    assert band_names([["a"], ["a"], ["a"]], None) == ["a", "a (1)", "a (2)"]
    assert band_names([["a", "b"], ["a"]], {"type": "suffix", "values": ["", "_x"]}) == ["a", "b", "a_x"]
    with pytest.raises(GraphError):
        band_names([["a"], ["b"]], {"type": "rename", "values": ["c", "c"]})


def test_scaling_overflow_is_no_data(ctx):
    node = make("RasterScaling", {"raster": raster(tile((0, 1), [[100, 200]]))}, slope={"type": "constant", "value": 2}, offset={"type": "constant", "value": 1})
    assert grid(node.query(ctx, Rect()))[0, 1] == [[201, None]]
    node = make("RasterScaling", {"raster": raster(tile((0, 1), [[100, 200]]))}, slope={"type": "constant", "value": 0.5}, offset={"type": "constant", "value": 0}, scaling_mode="subOffsetDivSlope")
    assert grid(node.query(ctx, Rect()))[0, 1] == [[None, None]]  # 0.5 is 0 as an integer


def test_expression_and_bands(ctx):
    source = raster(tile((0, 1), UP), tile((0, 1), [[1, None], [1, 1], [1, 1]], band=1), bands=("a", "b"))
    assert grid(make("Expression", {"raster": source}, expression="A + B").query(ctx, Rect()))[0, 1] == [[2.0, None], [4.0, 5.0], [6.0, 7.0]]
    assert grid(make("BandFilter", {"raster": source}, bands=("b",)).query(ctx, Rect()))[0, 1][0] == [1, None]
    with pytest.raises(GraphError):
        make("BandFilter", {"raster": source}, bands=("z",)).describe(ctx)


def test_resampling(ctx):
    up = make("Interpolation", {"raster": raster(tile((0, 1), UP))}, output_resolution={"type": "fraction", "x": 2, "y": 1})
    assert grid(up.query(ctx, Rect()))[0, 1] == [[1, 1, 2, 2], [3, 3, 4, 4], [5, 5, 6, 6]]
    assert up.describe(ctx).pixels == (0, 2, 0, 3)
    linear = make("Interpolation", {"raster": raster(tile((0, 1), UP), kind="F64")}, interpolation="biLinear", output_resolution={"type": "fraction", "x": 2, "y": 2})
    assert grid(linear.query(ctx, Rect(pixels=(0, 1, 0, 1))))[0, 1] == [[1.0, 1.5], [2.0, 2.5]]
    down = make("Downsampling", {"raster": raster(tile((0, 1), UP))}, output_resolution={"type": "fraction", "x": 1, "y": 3})
    assert grid(down.query(ctx, Rect()))[0, 1] == [[3, 4]]
    with pytest.raises(GraphError):
        make("Downsampling", {"raster": raster()}, output_resolution={"type": "resolution", "x": 0.5, "y": 1}).describe(ctx)


POINTS = op("MockFeatureCollectionSource", geometryType="MultiPoint", columns={"name": "text"}, rows=[[0, 10, [[0.5, 2.5]], "one"], [0, 25, [[1.5, 0.5], [0.5, 1.5]], "two"], [0, 10, [[50.0, 50.0]], "out"]])


def test_raster_vector_join(ctx):
    join = lambda **p: make("RasterVectorJoin", {"vector": from_json(POINTS), "rasters": (raster(*SERIES[:3]),)}, **p).query(ctx, Rect())
    split = sorted((r.t_start, r.t_end, r.name, r.a) for r in join(feature_aggregation="first").collect())
    assert split == [(0, 10, "one", 1), (0, 10, "out", None), (0, 10, "two", 6), (10, 20, "two", 1), (20, 25, "two", 6)]
    mean = {r.name: r.a for r in join(feature_aggregation="mean", temporal_aggregation="mean", temporal_aggregation_ignore_no_data=True).collect()}
    assert mean == {"one": 1.0, "two": pytest.approx((4.5 + 2.5 + 4.5) / 3), "out": 0.0}
    first = {r.name: r.a for r in join(feature_aggregation="first", temporal_aggregation="first", temporal_aggregation_ignore_no_data=True).collect()}
    assert first == {"one": 1, "two": 6, "out": 0}


@pytest.mark.parametrize("few", [0, 64])
def test_point_in_polygon_with_several_points_and_no_polygons(ctx, monkeypatch, few):
    monkeypatch.setattr("terrafold.operators.vector.FEW_POLYGONS", few)
    square = [[0, 5, [[[[0, 0], [1, 0], [1, 3], [0, 3], [0, 0]]]]]]
    node = op("PointInPolygonFilter", {"points": POINTS, "polygons": op("MockFeatureCollectionSource", geometryType="MultiPolygon", rows=square)})
    assert sorted(r.name for r in from_json(node).query(ctx, Rect()).collect()) == ["one", "two"]
    node["sources"]["polygons"]["params"]["rows"] = []
    assert from_json(node).query(ctx, Rect()).count() == 0


def test_vector_errors(ctx):
    for bad in (
        over("ColumnRangeFilter", POINTS, "vector", column="nope", ranges=[[1, 2]]),
        over("ColumnRangeFilter", POINTS, "vector", column="name", ranges=[]),
        over("VectorExpression", POINTS, "vector", expression="1", outputColumn="name"),
        over("VectorExpression", POINTS, "vector", expression="name", inputColumns=["name"]),
        over("LineSimplification", POINTS, "vector", epsilon=1.0),
        op("VectorJoin", {"left": POINTS, "right": POINTS}, leftColumn="name", rightColumn="name"),
    ):
        with pytest.raises(GraphError):
            from_json(bad).describe(ctx)
    for bad in ({"type": "Nope"}, over("TimeProjection", POINTS, "raster", step={}), op("BandFilter"), over("BandFilter", POINTS, bands=[], foo=1)):
        with pytest.raises(GraphError):
            from_json(bad)


def test_graphs_survive_json(ctx):
    graph = over("TimeShift", over("TimeProjection", POINTS, "vector", step={"granularity": "days", "step": 1}, stepReference=0), "source", kind="relative", granularity="hours", value=2)
    node = from_json(graph)
    assert from_json(node.to_json()).key() == node.key()
    assert Workflow(graph, ctx).id == Workflow(node.to_json(), ctx).id


def test_workflow_calls(ctx):
    flow = Workflow(raster(tile((0, 1), [[1, None], [3, 4], [5, 6]])), ctx)
    array = flow.get_array(Rect(pixels=(0, 2, 0, 1)))
    assert array.shape == (1, 3, 2) and array[0, 2, 1] == 6 and array.mask[0, 0, 1]
    assert len(Workflow(POINTS, ctx).get_dataframe()) == 3 == len(list(Workflow(POINTS, ctx).vector_stream()))
    series = Workflow(raster(*SERIES), ctx)
    assert sorted(map(tuple, series.time_slices().collect())) == [(0, 10), (10, 20), (20, 30), (30, 40)]
    assert [t.data for t in series.raster_stream(size=4)][3] == [None, 5, 4, 3, 2, 1]


def test_gaps():
    assert fill_gaps([(10, 20)], (0, 40), None, 0) == [(0, 10), (20, 40)]
    assert fill_gaps([(10, 20)], (0, 40), TimeStep("millis", 10), 0) == [(0, 10), (20, 30), (30, 40)]
    assert fill_gaps([], (0, 5), None, 0) == [(0, 5)]


def test_simplification():
    import numpy as np

    line = np.array([(i, math.sin(i) * 0.01) for i in range(50)])
    assert len(douglas_peucker(line, 0.5)) == 2
    assert len(visvalingam(line, 1.0, 2)) == 2
    corner = np.array([(0, 0), (5, 0.001), (10, 0), (10, 10)])
    assert douglas_peucker(corner, 0.1).tolist() == [[0, 0], [10, 0], [10, 10]]


def test_density_is_zero_far_away(ctx):
    node = from_json(over("Rasterization", POINTS, "vector", spatialResolution={"x": 1.0, "y": 1.0}, mode="density", cutoff=0.1, stddev=1.0, origin=[0.0, 3.0]))
    rows = {(r.y, r.x): r.value for r in node.query(ctx, Rect(time=(0, 1), pixels=(0, 2, 0, 9))).collect()}
    assert rows[0, 0] == pytest.approx((1 + math.exp(-0.5)) / math.sqrt(2 * math.pi)) or rows[0, 0] > 0
    assert rows[0, 9] == 0.0


def test_clustering_merges(ctx):
    from terrafold.operators.clustering import merge_circles

    rows = [{"n": 2, "x": 0.0, "y": 0.0, "t_start": 0, "t_end": 5}, {"n": 1, "x": 3.0, "y": 0.0, "t_start": 2, "t_end": 9}, {"n": 1, "x": 500.0, "y": 0.0, "t_start": 0, "t_end": 1}]
    out = merge_circles(rows, 4.0, 1.0, 1.0, {})
    assert [(c["n"], c["x"], c["t_start"], c["t_end"]) for c in out] == [(3, 1.0, 0, 9), (1, 500.0, 0, 1)]


@pytest.mark.parametrize("few", [0, 64])
def test_equal_features_stay_apart(ctx, monkeypatch, few):
    monkeypatch.setattr("terrafold.operators.vector.FEW_POLYGONS", few)
    twice = op("MockFeatureCollectionSource", geometryType="MultiPoint", columns={"a": "int", "b": "int"}, rows=[[0, 25, [[0.5, 2.5], [1.5, 0.5]], 1, None]] * 2 + [[0, 25, [[0.5, 2.5], [1.5, 0.5]], None, 1]])
    square = op("MockFeatureCollectionSource", geometryType="MultiPolygon", rows=[[0, 50, [[[[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]]]]])
    inside = op("PointInPolygonFilter", {"points": twice, "polygons": square})
    assert from_json(inside).query(ctx, Rect()).count() == 3
    joined = make("RasterVectorJoin", {"vector": from_json(inside), "rasters": (raster(*SERIES[:2]),)}, names={"type": "names", "values": ["v"]}, feature_aggregation="mean")
    assert sorted((r.t_start, r.v) for r in joined.query(ctx, Rect()).collect()) == [(0, 3.5)] * 3 + [(10, 3.5)] * 3
