from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.model.time import MAX_MS, MIN_MS, TimeStep, interval_intersects, intersects, to_ms

CASES = [
    ("millis", 7, "1970-01-01", "1970-01-01T00:00:00.020", "1970-01-01T00:00:00.014"),
    ("seconds", 1, "2000-01-01", "1999-12-31T23:59:59.500", "2000-01-01"),  # half a unit before the reference counts as none
    ("seconds", 1, "2000-01-01", "1999-12-31T23:59:58.500", "1999-12-31T23:59:59"),
    ("minutes", 15, "2014-01-01", "2014-01-01T12:34:56", "2014-01-01T12:30:00"),
    ("hours", 6, "2014-01-01", "2014-01-02T05:00:00", "2014-01-02"),
    ("days", 2, "1970-01-01", "1970-01-04T12:00:00", "1970-01-03"),
    ("months", 1, "2010-01-01", "2014-07-31T10:00:00", "2014-07-01"),
    ("months", 3, "2010-02-01", "2014-07-31", "2014-05-01"),
    ("months", 1, "2014-03-15", "2014-02-01", "2014-02-15"),  # only year and month of the time count
    ("months", 2, "2014-03-01", "2013-12-31", "2013-11-01"),
    ("years", 1, "2014-05-01", "2016-01-01", "2016-05-01"),
    ("years", 5, "2000-01-01", "1999-12-31", "1995-01-01"),
]


@pytest.mark.parametrize(("granularity", "step", "reference", "time", "expected"), CASES)
def test_snap_of_numbers(granularity, step, reference, time, expected):
    assert TimeStep(granularity, step).snap_ms(to_ms(time), to_ms(reference)) == to_ms(expected)


def test_columns_snap_and_add_as_numbers_do(spark):
    times = [to_ms(t) for *_, t, _ in CASES] + [0, -1, 1, 951_782_400_000, MIN_MS, MAX_MS]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    for granularity, n, reference, *_ in CASES:
        step, ref = TimeStep(granularity, n), to_ms(reference)
        rows = df.select("t", step.snap(F.col("t"), ref).alias("s"), step.add(F.col("t")).alias("a"), step.add(F.col("t"), -1).alias("b")).collect()
        for r in rows:
            assert (r.s, r.a, r.b) == (step.snap_ms(r.t, ref), step.add_ms(r.t), step.add_ms(r.t, -1)), (granularity, n, r.t)


@given(st.sampled_from(["seconds", "hours", "days", "months", "years"]), st.integers(1, 50), st.integers(-(10**12), 4 * 10**12))
def test_steps_cover_an_interval_without_gaps(granularity, n, start):
    step = TimeStep(granularity, n)
    end = min(step.add_ms(start, 4), start + 10**12)
    own = step.steps(start, end)
    assert own[0][0] <= max(start, own[0][0]) and own[-1][1] >= end or granularity in ("months", "years") or start < 0
    assert all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_intersections(spark):
    pairs = [((0, 10), (10, 20)), ((0, 10), (9, 20)), ((5, 5), (5, 5)), ((5, 5), (0, 5)), ((5, 5), (5, 9)), ((0, 9), (3, 4)), ((3, 3), (0, 9)), ((1, 2), (3, 4))]
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], "a long, b long, c long, d long")
    got = [r[0] for r in df.select(intersects(*map(F.col, "abcd"))).collect()]
    assert got == [interval_intersects(a, b) for a, b in pairs] == [False, True, True, False, True, True, True, False]


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        TimeStep("weeks", 1)
    with pytest.raises(ValueError):
        TimeStep("days", 0)
