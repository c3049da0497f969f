"""Rectangles over word boxes: an equi-join by cells of a page's grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.sources.staging import BROADCAST_ROWS, staged

#: Boxes of a cell, about, and cells of a page along one side at most.
PER_CELL, SIDE = 64, 1 << 12


def _grids(boxes: DataFrame, page: list[str]) -> DataFrame:
    """One row for each page: the corner of its boxes, and sides of cells that hold about PER_CELL boxes each and are no smaller
    than the mean box, so that a box is in few cells on average."""
    stats = boxes.groupBy(*page).agg(
        F.count("*").alias("n"),
        *(F.min(low).alias(f"_{at}") for at, low in (("x", "x0"), ("y", "top"))),
        *((F.max(high) - F.min(low)).alias(f"_{at}_wide") for at, low, high in (("x", "x0", "x1"), ("y", "top", "bottom"))),
        *(F.avg(F.col(high) - F.col(low)).alias(f"_{at}_mean") for at, low, high in (("x", "x0", "x1"), ("y", "top", "bottom"))),
    )
    most = F.least(F.ceil(F.sqrt(F.col("n") / PER_CELL)), F.lit(SIDE))

    def side(at: str) -> list[Column]:
        few = F.floor(F.col(f"_{at}_wide") / F.greatest(F.col(f"_{at}_mean"), F.lit(1e-9)))
        cells = F.greatest(F.least(most, few), F.lit(1)).cast("int")
        return [cells.alias(f"_{at}_cells"), F.greatest(F.col(f"_{at}_wide") / cells, F.lit(1e-9)).alias(f"_{at}_side")]

    return stats.select(*page, "_x", "_y", *side("x"), *side("y"))


def _cell(c: Column, at: str) -> Column:
    """The cell of a coordinate; what lies outside the boxes of the page belongs to the outermost cells."""
    return F.least(F.greatest(F.floor((c - F.col(f"_{at}")) / F.col(f"_{at}_side")), F.lit(0)), F.col(f"_{at}_cells") - 1).cast("int")


def _in_cells(df: DataFrame, low: tuple[Column, Column], high: tuple[Column, Column]) -> DataFrame:
    """A row for each cell that a shape touches."""
    for at, a, b in (("x", low[0], high[0]), ("y", low[1], high[1])):
        df = df.withColumn(f"_c{at}", F.explode(F.sequence(_cell(a, at), _cell(b, at))))
    return df


def overlaps(rectangles: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of rectangles (page columns, x0, y0, x1, y1, others) and boxes (page columns, x0, top, x1, bottom, others) of a page
    that overlap; edges that touch count. Columns of a pair: the rectangle's, and ``box``, a struct of the box's others.

    Both are put into all cells of their page's grid that they touch, and meet by cell; a pair that meets in several is kept in
    that of its upper left common point alone, so nothing is compared twice or dropped after. A page of very many boxes has
    very many cells, which go to many tasks. Null pages, and shapes with a null or reversed side, meet nothing. Rows that
    repeat give repeated pairs.
    """
    sane = lambda df, x0, y0, x1, y1: df.where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)))
    rest = [c for c in boxes.columns if c not in (*page, "x0", "top", "x1", "bottom")]
    known = sane(boxes, "x0", "top", "x1", "bottom").select(*page, "x0", "top", "x1", "bottom", F.struct(*rest).alias("box"))
    grids = staged(_grids(known, page), "grids")
    few = F.broadcast(grids) if grids.count() <= BROADCAST_ROWS else grids
    left = _in_cells(sane(rectangles, "x0", "y0", "x1", "y1").join(few, page), (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
    right = _in_cells(known.join(few, page), (F.col("x0"), F.col("top")), (F.col("x1"), F.col("bottom")))
    right = right.select(*page, "_cx", "_cy", F.col("x0").alias("_x0"), F.col("top").alias("_y0"), F.col("x1").alias("_x1"), F.col("bottom").alias("_y1"), "box")
    met = left.join(right, [*page, "_cx", "_cy"]).where("x0 <= _x1 AND x1 >= _x0 AND y0 <= _y1 AND y1 >= _y0")
    own = (F.col("_cx") == _cell(F.greatest("x0", "_x0"), "x")) & (F.col("_cy") == _cell(F.greatest("y0", "_y0"), "y"))
    return met.where(own).select(*rectangles.columns, "box")


def spans(rectangles: DataFrame, boxes: DataFrame, page: list[str], key: str = "id", position: str = "pos") -> DataFrame:
    """Rows (key, first, last): the least and greatest position of a word that each rectangle overlaps, null for none."""
    hits = overlaps(rectangles.select(key, *page, "x0", "y0", "x1", "y1"), boxes.select(*page, "x0", "top", "x1", "bottom", position), page)
    ends = hits.groupBy(key).agg(F.min(f"box.{position}").alias("first"), F.max(f"box.{position}").alias("last"))
    return rectangles.select(key).distinct().join(ends, key, "left")
