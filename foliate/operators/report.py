"""Reports of papers as text, and the settings and checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators.structure import DIMENSIONS

#: Section titles in the order of DIMENSIONS, and formats that files may have (fixed values).
TITLES = ("一、研究背景", "二、核心观点", "三、研究方法", "四、创新点", "五、研究结论", "六、参考文献")
SUFFIXES = ("pdf", "txt", "docx", "doc")


def rendered(title: Column, author: Column, time: Column, source: Column, keywords: Column, sections: list[Column]) -> Column:
    """The report's text: a head with what is known of the paper, then every section that isn't blank."""
    known = lambda c: F.when(tx.is_blank(c), "未知").otherwise(c)
    head = [F.concat(F.lit("文献标题："), F.when(tx.is_blank(title), "未命名文献").otherwise(title)), F.concat(F.lit("作者："), known(author)), F.concat(F.lit("发表时间："), known(time)), F.concat(F.lit("期刊/来源："), known(source))]
    words = F.when(~tx.is_blank(keywords), F.concat(F.lit("关键词："), keywords))
    block = lambda name, body: F.concat(F.lit(f"{name}\n{'=' * 40}\n"), body, F.lit("\n"))
    parts = [F.when(~tx.is_blank(body), block(name, tx.strip(body))) for name, body in zip(TITLES, sections, strict=True)]
    return F.concat_ws("\n", block("文献基础信息", F.concat_ws("\n", *head, words)), *parts)


def text_reports(library: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows (id, file, report) of papers with a report (id, keywords and the columns of DIMENSIONS)."""
    both = library.join(reports, "id")
    body = rendered(F.col("title"), F.col("author"), F.col("publish_time"), F.col("journal_source"), F.col("keywords"), [F.col(d) for d in DIMENSIONS])
    return both.select("id", F.concat(F.lit("解析报告_"), tx.safe_name(F.col("title")), F.lit("_"), F.col("id").cast("string"), F.lit(".txt")).alias("file"), body.alias("report"))


def file_fault(path: Column, size: Column) -> Column:
    """Why a file can't be taken in, or null: no path, a suffix of no known format, or no content; the first counts."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(tx.is_blank(path), "no path").when(~suffix.isin(*SUFFIXES), "format").when(F.coalesce(size, F.lit(0)) <= 0, "empty")


def within(path: Column, base: str) -> Column:
    """The path with . and .. resolved stays below base."""
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, r"[/\\]"), F.array().cast("array<string>"), step), "/"))
    return (resolved == base) | resolved.startswith(base.rstrip("/") + "/")


def page_numbers(c: Column) -> Column:
    """Whole numbers of a comma-separated list; others are skipped."""
    return F.filter(F.transform(F.split(c, "[,，]"), lambda p: tx.strip(p).try_cast("int")), lambda n: n.isNotNull())


def filled_switches(c: Column, names: tuple[str, ...] = DIMENSIONS) -> Column:
    """A JSON object of switches as a map with every name; missing ones are on, bad JSON is empty."""
    given = F.coalesce(F.from_json(c, "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))
    keys = F.array(*map(F.lit, names))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(given, k), F.lit(True))))


def settings(config: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """All settings (config_key, config_value): the stored value, or the default of keys that have none."""
    rows = config.sparkSession.createDataFrame(sorted(defaults.items()), "config_key string, _default string")
    return rows.join(config, "config_key", "full").select("config_key", F.coalesce("config_value", "_default").alias("config_value"))
