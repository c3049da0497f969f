"""Ranges of about equal bytes over the order of two columns, found from the rows alone and the same in every run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.llm.shared import discard, stored

#: Ranges at most, whatever the input: what the driver and each task hold of them is bounded; larger input has larger ranges.
MOST = 1 << 16

Cuts = list[tuple[int | None, int]]


def cuts(rows: DataFrame, weight: Column, limit: int, most: int = MOST) -> Cuts:
    """(a, b) at which new ranges begin, for rows (a, b: whole numbers, nulls of a first): each range but the last
    has about ``limit`` in weight, more where there would be over ``most`` ranges. Rows with equal (a, b) share one.

    A narrow table is ranged and summed part by part, so that neither its sampled bounds nor the order of
    tasks shows in the result. Texts don't move.
    """
    narrow = rows.select("a", "b", weight.cast("long").alias("w"))
    total = narrow.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    ranges = min(most, -(-total // limit))
    if ranges <= 1:
        return []
    placed = stored(narrow.repartitionByRange("a", "b").withColumn("part", F.spark_partition_id()), "placed")
    # one row for each part
    base = placed.groupBy("part").agg(F.sum("w").alias("own")).withColumn("base", F.sum("own").over(Window.orderBy("part")) - F.col("own"))
    before = F.sum("w").over(Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    number = F.floor((F.col("base") + F.col("before")) * F.lit(ranges) / F.lit(total))
    first = placed.withColumn("before", before).join(F.broadcast(base.select("part", "base")), "part").groupBy(number.alias("n")).agg(F.min(F.struct("a", "b")).alias("cut"))
    found = sorted({(r.cut.a, r.cut.b) for r in first.where("n > 0").collect()}, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
    discard(placed)
    return found


def number(a: Column, b: Column, found: Cuts) -> Column:
    """How many cuts lie at or before (a, b): a binary search, so that a row costs the logarithm of their number."""
    if not found:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"a": x, "b": y} for x, y in found])), "array<struct<a: bigint, b: bigint>>")
    own = F.struct(a.alias("a"), b.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        ahead = (s["low"] < s["high"]) & (F.get(table, middle) <= own)
        return F.struct(F.when(ahead, middle + 1).otherwise(s["low"]).alias("low"), F.when(ahead | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.lit(len(found).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(found)).alias("high")), halve, lambda s: s["low"])
