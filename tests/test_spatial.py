"""The join of rectangles with word boxes gives the pairs of a comparison of all."""

import random

import pytest

from foliate.operators import spatial as sp

RECTANGLES, BOXES = "id long, page long, x0 double, y0 double, x1 double, y1 double", "page long, pos long, x0 double, top double, x1 double, bottom double"


def meets(r, b):
    return r[2] <= b[4] and r[4] >= b[2] and r[3] <= b[5] and r[5] >= b[3] and r[2] <= r[4] and r[3] <= r[5] and b[2] <= b[4] and b[3] <= b[5]


@pytest.mark.parametrize(("seed", "cell"), [(1, 64), (2, 1), (3, 3)])
def test_pairs_match_a_comparison_of_all(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(sp, "PER_CELL", cell)
    rng = random.Random(seed)
    grid = lambda: float(rng.randrange(0, 60))
    boxes = [(rng.randrange(3), i, x := grid(), y := grid(), x + rng.choice([0, 1, 5, 50]), y + rng.choice([0, 1, 5])) for i in range(250)]
    rects = [(i, rng.randrange(4), x := grid() - 10, y := grid() - 10, x + rng.choice([-1, 0, 4, 30, 900]), y + rng.choice([0, 4, 200])) for i in range(60)]
    got = sp.overlaps(spark.createDataFrame([*rects, (900, None, 0.0, 0.0, 9.0, 9.0), (901, 1, None, 0.0, 9.0, 9.0)], RECTANGLES), spark.createDataFrame([*boxes, (None, 9, 0.0, 0.0, 9.0, 9.0)], BOXES), ["page"])
    assert sorted((r.id, r.box.pos) for r in got.collect()) == sorted((r[0], b[1]) for r in rects for b in boxes if r[1] == b[0] and meets(r, b))


def test_edges_spans_and_empty_sides(spark):
    rects = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 100.0, 0.0, 110.0, 10.0), (3, 7, 0.0, 0.0, 1.0, 1.0)], RECTANGLES)
    boxes = spark.createDataFrame([(0, 5, 10.0, 10.0, 12.0, 12.0), (0, 3, 4.0, 4.0, 5.0, 5.0), (0, 9, 10.5, 0.0, 12.0, 1.0)], BOXES)
    assert sorted(map(tuple, sp.spans(rects, boxes, ["page"]).collect())) == [(1, 3, 5), (2, None, None), (3, None, None)]
    assert sp.overlaps(rects, boxes.limit(0), ["page"]).count() == 0 and sp.overlaps(rects.limit(0), boxes, ["page"]).count() == 0


def test_a_full_page_goes_to_many_tasks(spark):
    """A page of very many words is cut into cells, which a hash deals out; no pairs are compared beside the cells."""
    boxes = spark.range(100_000).selectExpr("id DIV 1000000 AS page", "id AS pos", "CAST(id % 400 AS DOUBLE) AS x0", "CAST(id DIV 400 AS DOUBLE) AS top", "CAST(id % 400 AS DOUBLE) + 0.9 AS x1", "CAST(id DIV 400 AS DOUBLE) + 0.9 AS bottom")
    rects = spark.createDataFrame([(1, 0, 10.0, 10.0, 20.0, 20.0), (2, 0, -5.0, -5.0, 1e9, 1e9)], RECTANGLES)
    pairs = sp.overlaps(rects, boxes, ["page"])
    counts = {r.id: r["count"] for r in pairs.groupBy("id").count().collect()}
    assert counts == {1: sum(x + 0.9 >= 10 and x <= 20 for x in range(400)) * sum(y + 0.9 >= 10 and y <= 20 for y in range(250)), 2: 100_000}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sp._grids(boxes, ["page"]).first()["_x_cells"] == 40
