"""Filters and searches over the library, as folds of column predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import contains_literal, strip

#: Columns that a search may be sorted by (fixed values), the first by default.
SORTS = ("create_time", "title", "publish_time", "file_size")


@dataclass(frozen=True)
class Filters:
    """What a search asks for; None and blank values ask for nothing."""

    keyword: str | None = None
    tag_id: int | None = None
    category_id: int | None = None
    lit_type: str | None = None
    year: str | None = None
    parsed: str | None = None  # done or todo
    since: datetime | None = None
    before: datetime | None = None
    sort: str = SORTS[0]
    ascending: bool = False


def period(key: str | None, today: datetime) -> tuple[datetime | None, datetime | None]:
    """Bounds of this_week (from Monday), this_month, this_year and older_than_year; others have none."""
    day = today.replace(hour=0, minute=0, second=0, microsecond=0)
    starts = {"this_week": day - timedelta(days=day.weekday()), "this_month": day.replace(day=1), "this_year": day.replace(month=1, day=1)}
    if key == "older_than_year":
        return None, today - timedelta(days=365)
    return starts.get(key), None


def of_year(year: str) -> Column:
    """Published in the year, or without a publication time and taken in then."""
    published = F.coalesce(strip(F.col("publish_time")), F.lit(""))
    return published.startswith(year) | ((published == "") & (F.year("create_time").cast("string") == year))


def predicates(f: Filters) -> list[Column]:
    """Conditions on the library's own columns, all of which reach the scan."""
    out = []
    if f.category_id:
        out.append(F.col("category_id") == f.category_id)
    if f.lit_type and f.lit_type.strip():
        out.append(F.col("lit_type") == f.lit_type.strip())
    if f.year and f.year.strip():
        out.append(of_year(f.year.strip()))
    if f.parsed in ("done", "todo"):
        out.append((F.col("is_parsed") == 2) if f.parsed == "done" else (F.col("is_parsed") != 2))
    if f.since is not None:
        out.append(F.col("create_time") >= F.lit(f.since).cast("timestamp_ntz"))
    if f.before is not None:
        out.append(F.col("create_time") < F.lit(f.before).cast("timestamp_ntz"))
    return out


def keyword_hits(lit: DataFrame, bindings: DataFrame, tags: DataFrame, notes: DataFrame, reports: DataFrame, keyword: str) -> DataFrame:
    """Papers with the keyword in title, author or source, a tag's name, a note or any version of a report.

    The other tables give distinct ids of hits, which join once each: no row is repeated.
    """
    named = bindings.join(tags.where(contains_literal(F.col("tag_name"), keyword)).select(F.col("id").alias("tag_id")), "tag_id").select("lit_id")
    noted = notes.where(contains_literal(F.col("note_content"), keyword)).select("lit_id")
    reported = reports.where(contains_literal(F.col("core_view"), keyword)).select("lit_id")
    elsewhere = named.union(noted).union(reported).distinct().select(F.col("lit_id").alias("_hit"))
    own = F.lit(False)
    for c in ("title", "author", "journal_source"):
        own = own | contains_literal(F.col(c), keyword)
    return lit.join(elsewhere, F.col("id") == F.col("_hit"), "left").where(own | F.col("_hit").isNotNull()).drop("_hit")


def search(lit: DataFrame, bindings: DataFrame, tags: DataFrame, notes: DataFrame, reports: DataFrame, f: Filters) -> DataFrame:
    """All conditions together, sorted by a whitelisted column, then by id downwards."""
    found = lit
    for condition in predicates(f):
        found = found.where(condition)
    if f.tag_id:
        found = found.join(bindings.where(F.col("tag_id") == f.tag_id).select(F.col("lit_id").alias("_l")), F.col("id") == F.col("_l"), "left_semi")
    if f.keyword and f.keyword.strip():
        found = keyword_hits(found, bindings, tags, notes, reports, f.keyword)
    by = f.sort if f.sort in SORTS else SORTS[0]
    return found.orderBy(F.col(by).asc() if f.ascending else F.col(by).desc(), F.col("id").desc())


def attach_tags(lit: DataFrame, bindings: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds category (name, or null) and tags (names in binding order, without dangling ones and without the
    one that is called as the category)."""
    categories = tags.where("tag_type = 1").select(F.col("id").alias("category_id"), F.col("tag_name").alias("category"))
    labels = tags.select(F.col("id").alias("tag_id"), "tag_name")
    bound = bindings.join(labels, "tag_id").groupBy("lit_id").agg(F.array_sort(F.collect_list(F.struct("id", "tag_name"))).alias("_t"))
    both = lit.join(categories, "category_id", "left").join(bound.withColumnRenamed("lit_id", "_l"), F.col("id") == F.col("_l"), "left")
    names = F.coalesce(F.transform("_t", lambda t: t["tag_name"]), F.array().cast("array<string>"))
    return both.withColumn("tags", F.filter(names, lambda n: F.col("category").isNull() | (n != F.col("category")))).drop("_t", "_l")
