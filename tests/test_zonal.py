import math
import random

import numpy as np
import pytest

from orogen.operators import zonal


def percentile(values, share):
    """As sorting says it."""
    v = sorted(values)
    at = (len(v) - 1) * share
    low, high = math.floor(at), math.ceil(at)
    return v[low] if v[low] == v[high] else (high - at) * v[low] + (at - low) * v[high]


def bounds(spark, rows, low, high):
    return {r.zone: (r.low, r.high) for r in zonal.percent_bounds(spark.createDataFrame(rows, "zone string, z double").repartition(3), "zone", low, high).collect()}


@pytest.mark.parametrize("low, high", [(5.0, 10.0), (0.25, 0.0), (0.0, 0.0), (60.0, 60.0), (33.3, 1.7)])
def test_bounds_equal_sorting(spark, low, high):
    r = random.Random(low)
    make = [lambda: r.gauss(0, 1), lambda: r.choice([-1e308, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1e308, math.inf, -math.inf]), lambda: float(r.randint(0, 3)), lambda: 1000 + r.random() * 1e-9, lambda: r.uniform(-1, 1) * 10 ** r.randint(-300, 300)]
    zones = {f"z{i}": [f() for _ in range(r.randint(1, 400))] for i, f in enumerate(make * 3)} | {"one": [7.5], "two": [2.0, -2.0]}
    rows = [(z, v) for z, values in zones.items() for v in values] + [("one", None), ("none", None), (None, 1.0)]
    got, want = bounds(spark, rows, low, high), {}
    for z, values in zones.items():
        a, b = percentile(values, low / 100), percentile(values, 1 - high / 100)
        want[z] = (min(values), max(values)) if a >= b or math.isnan(a) or math.isnan(b) else (a, b)
    assert set(got) == set(want)
    for z in want:
        assert all(g == w or g == pytest.approx(w, rel=1e-15) or (math.isnan(g) and math.isinf(w)) for g, w in zip(got[z], want[z])), (z, got[z], want[z])


def test_keys_keep_the_order(spark):
    values = [-math.inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values + [-0.0]], "v double").select("v", zonal.sort_key(zonal.F.col("v")).alias("k"))
    rows = df.select("v", "k", zonal.key_value(zonal.F.col("k")).alias("again")).collect()
    keys = [r.k for r in rows]
    assert keys[:-1] == sorted(set(keys)) and keys[-1] == keys[4]
    assert all(r.again == r.v or math.isnan(r.v) and math.isnan(r.again) for r in rows)


def test_a_large_zone_needs_no_memory_of_its_values(spark):
    """As many different values as cells: only counts by 16 bits are held and sent."""
    cells = spark.range(300_000).selectExpr("cast(id % 2 as int) as zone", "sin(id) * 1000 as z")
    got = {r.zone: (r.low, r.high) for r in zonal.percent_bounds(cells, "zone", 2.0, 2.0).collect()}
    values = np.array([r.z for r in cells.select("z").collect()])
    ids = np.arange(len(values))
    for zone in (0, 1):
        own = values[ids % 2 == zone]
        assert got[zone] == pytest.approx((percentile(own, 0.02), percentile(own, 0.98)), rel=1e-15)


def test_empty(spark):
    assert bounds(spark, [], 5.0, 5.0) == {}
