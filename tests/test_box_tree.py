"""The quadtree of boxes against the first match by brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import geo

BOX = "ord long, code string, min_lat double, max_lat double, min_lon double, max_lon double"


def first_match(boxes, y, x):
    """Codes of the first box per point; ``boxes`` in the order of ord."""
    out = np.full(len(y), geo.DEFAULT_REGION, object)
    open_ = np.ones(len(y), bool)
    for _, code, a, b, c, d in boxes:
        hit = open_ & (y >= (-90 if a is None else a)) & (y <= (90 if b is None else b)) & (x >= (-180 if c is None else c)) & (x <= (180 if d is None else d))
        out[hit] = code
        open_ &= ~hit
    return out.tolist()


def located(spark, boxes, y, x, **kwargs):
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "id long, lat double, lon double")
    tree = geo.BoxTree(spark.createDataFrame(boxes, BOX), **kwargs)
    rows = tree.locate(points, "lat", "lon", "region", geo.DEFAULT_REGION).collect()
    assert len(rows) == len(y)
    return tree, [r.region for r in sorted(rows, key=lambda r: r.id)]


def some_boxes(rng, n, size):
    out = []
    for i in range(n):
        a, c = np.round(rng.uniform(-90, 85), 1), np.round(rng.uniform(-180, 170), 1)
        b = [a, a + rng.uniform(0, size), None, c, c + rng.uniform(0, 2 * size), None]
        out.append((i, f"r{i}", *[None if rng.random() < 0.03 else float(b[k]) for k in (0, 1)], *[None if rng.random() < 0.03 else float(b[k]) for k in (3, 4)]))
    return out


@pytest.mark.parametrize("leaf, depth", [(4, 10), (32, 10), (4, 2)])
def test_first_match_equals_brute_force(spark, leaf, depth):
    rng = np.random.default_rng(leaf)
    boxes = some_boxes(rng, 600, 15)
    y, x = rng.uniform(-95, 95, 800), rng.uniform(-185, 185, 800)
    # Points on the edges and corners of boxes, which count as inside.
    y[:200], x[:200] = [b[2] or 0 for b in boxes[:200]], [b[4] or 0 for b in boxes[:200]]
    y[200:300], x[200:300] = [b[3] or 0 for b in boxes[:100]], [b[5] or 0 for b in boxes[:100]]
    order = rng.permutation(600).tolist()
    tree, got = located(spark, [boxes[i] for i in order], y, x, leaf_boxes=leaf, max_depth=depth)
    assert got == first_match(boxes, y, x)
    assert tree.leaves.agg(F.max(F.size("boxes"))).first()[0] <= leaf
    assert (tree.rest is not None) == (depth == 2)


def test_many_boxes_over_one_corner(spark):
    """Copies, nested boxes with one corner, and a box over everything: no list grows beyond its limit."""
    boxes = [(i, f"n{i}", 10.0, 10.0 + 0.01 * (i % 400 + 1), 20.0, 20.0 + 0.01 * (i % 300 + 1)) for i in range(3000)] + [(5000, "all", None, None, None, None)]
    rng = np.random.default_rng(1)
    y, x = np.append(rng.uniform(9.9, 14.5, 300), [10.0, 10.0]), np.append(rng.uniform(19.9, 23.5, 300), [20.0, 23.0])
    tree, got = located(spark, boxes, y, x, leaf_boxes=8)
    assert got == first_match(boxes, y, x)
    assert tree.leaves.agg(F.max(F.size("boxes"))).first()[0] <= 8


def test_odd_points_and_boxes(spark):
    boxes = [(1, "a", 0.0, 1.0, 0.0, 1.0), (2, "turned", 5.0, 4.0, 0.0, 1.0), (3, "point", 2.0, 2.0, 2.0, 2.0)]
    points = spark.createDataFrame([(1, None, 0.5), (2, float("nan"), 0.5), (3, 2.0, 2.0), (4, 0.5, 0.5), (5, 4.5, 0.5), (6, 1.0, 1.0)], "id int, lat double, lon double")
    got = {r.id: r.region for r in geo.enrich_region_from_table(points, spark.createDataFrame(boxes, BOX), "lat", "lon").collect()}
    assert got == {1: "UNKNOWN", 2: "UNKNOWN", 3: "point", 4: "a", 5: "UNKNOWN", 6: "a"}
    none = geo.enrich_region_from_table(points, spark.createDataFrame([], BOX), "lat", "lon")
    assert [r.region for r in none.collect()] == ["UNKNOWN"] * 6


def test_a_hundred_thousand_boxes(spark):
    rng = np.random.default_rng(5)
    a, c = rng.uniform(-90, 80, 100_000), rng.uniform(-180, 170, 100_000)
    h, w = rng.uniform(0, 3, 100_000), rng.uniform(0, 6, 100_000)
    frame = pd.DataFrame({"ord": np.arange(100_000), "code": [f"b{i}" for i in range(100_000)], "min_lat": a, "max_lat": a + h, "min_lon": c, "max_lon": c + w})
    boxes = spark.createDataFrame(frame, BOX)
    y, x = rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)
    points = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(y, x))], "id long, lat double, lon double")
    tree = geo.BoxTree(boxes)
    got = {r.id: r.region for r in tree.locate(points, "lat", "lon", "region", "none").collect()}
    assert tree.rest is None and tree.leaves.agg(F.max(F.size("boxes"))).first()[0] <= geo.LEAF_BOXES
    for i in range(400):
        hit = np.flatnonzero((a <= y[i]) & (y[i] <= a + h) & (c <= x[i]) & (x[i] <= c + w))
        assert got[i] == (f"b{hit[0]}" if len(hit) else "none")
