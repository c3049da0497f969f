"""Category trees of any depth, and rows numbered by ranges."""

import random
import time

from pyspark.sql import functions as F

from foliate.operators import tables as tb
from foliate.operators import trees as tr

NODES = "id long, name string, parent_id long"


def test_a_chain_of_a_thousand_and_a_circle(spark):
    chain = [(i, f"n{i}", i - 1) for i in range(1, 1001)]
    circle = [(2000 + i, f"c{i}", 2000 + (i + 1) % 100) for i in range(100)]
    below = [(3000, "below", 2000), (3001, "orphan", 9999), (3002, "of orphan", 3001)]
    nodes = spark.createDataFrame(chain + circle + below, NODES).repartition(3)
    began = time.perf_counter()
    got = {r.id: r.path for r in tr.paths(nodes, F.col("id")).collect()}
    assert time.perf_counter() - began < 60
    assert got == {i: list(range(1, i + 1)) for i in range(1, 1001)}
    assert sorted(r.id for r in tr.circles(nodes).collect()) == list(range(2000, 2100))


def test_trees_match_a_walk(spark):
    rng = random.Random(4)
    rows = [(i, f"n{i % 9}", rng.choice([0, 0, rng.randrange(1, 80), i, 500])) for i in range(1, 80)]
    up = {i: p for i, _, p in rows}

    def ancestors(i):
        seen = []
        while i in up and i not in seen:
            seen.append(i)
            i = up[i]
        return seen if i == 0 else None

    want = {i: a[::-1] for i in up if (a := ancestors(i))}
    nodes = spark.createDataFrame(rows, NODES)
    assert {r.id: r.path for r in tr.paths(nodes, F.col("id")).collect()} == want
    assert sorted(map(tuple, tr.descendants(nodes).collect())) == sorted((a, i) for i, p in want.items() for a in p[:-1])

    def circular(i):
        at = up[i]
        for _ in range(len(up)):
            if at == i:
                return True
            at = up.get(at)
        return False

    assert sorted(r.id for r in tr.circles(nodes).collect()) == sorted(i for i in up if circular(i))
    assert tr.paths(nodes.limit(0), F.col("id")).count() == 0 and tr.circles(nodes.limit(0)).count() == 0


def test_pre_order_of_deep_categories(spark):
    rows = [(i, 1, f"t{i}", max(i - 1, 0), i % 3) for i in range(1, 41)] + [(100 + i, 1, f"s{i}", 5, -i) for i in range(3)] + [(900, 2, "label", 0, 0)]
    tree = tr.tag_tree(spark.createDataFrame(rows, "id long, tag_type int, tag_name string, parent_id long, sort_order int"))
    order = [r.id for r in tree.orderBy("key").collect()]
    assert order == [1, 2, 3, 4, 5, 102, 101, *range(6, 41), 100] and {r.id: r.depth for r in tree.collect()}[40] == 39


def test_one_far_value_leaves_ranges_even(spark):
    """An outlying id doesn't put all others into one task."""
    ids = spark.range(20_000).union(spark.createDataFrame([(1 << 60,)], "id long"))
    got = tb.ranked(ids, "id")
    assert got.agg(F.max("_n"), F.count_distinct("_n"), F.sum((F.col("_n") == F.col("id") + 1).cast("int"))).first() == (20_001, 20_001, 20_000)
    placed = ids.repartitionByRange(4, "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in placed) < 8_000
