"""String functions as Column expressions, with the library's conventions for blanks and case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text processing outside the JVM sees it (fixed values): ASCII, information separators, NEL, NBSP and Unicode spaces.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Codes of faults; others have the code 1 (fixed values).
ERROR_CODES = {"missing": 2, "invalid": 3, "parse": 4, "db": 5, "space": 6, "duplicate": 7, "permission": 8, "model": 9}
KEYWORDS_AT_MOST = 20
#: Units of sizes from 1024 bytes on (fixed values).
SIZE_UNITS = ("KB", "MB", "GB", "TB")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences; the ASCII stop is none, as abbreviations have it (fixed values).
SENTENCE_ENDS = "。！？!?”’"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends: only the ends are looked at, where a pattern would try each blank within."""
    return F.trim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as the search compares."""
    return F.translate(c, _UPPER, _LOWER)


def contains_literal(c: Column, keyword: str) -> Column:
    """Substring test with ASCII case folding; %, _ and backslash stand for themselves; a blank keyword matches all."""
    word = keyword.strip()
    return F.lit(True) if not word else F.coalesce(ascii_lower(c).contains("".join(_LOWER[_UPPER.index(x)] if x in _UPPER else x for x in word)), F.lit(False))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def lines(c: Column) -> Column:
    """Lines at every line separator; a final separator ends the last line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(F.split(F.coalesce(c, F.lit("")), r"\R|[\x1c-\x1e]"), whole)


def line_paragraphs(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Stripped paragraphs between empty lines; lines of white space count as empty."""
    level = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)^[ \t\u3000\u00a0]+$", "")
    return F.filter(F.transform(F.split(level, "\n\n"), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case words of two characters or more: Latin words and digits, and overlapping pairs of Han characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9ß-öø-ɏ]{2,}"), F.lit(0))
    # the range, which holds all Han characters, is far quicker to tell than the script
    runs = F.regexp_extract_all(low, F.lit(r"[\x{2e80}-\x{3ffff}&&\p{IsHan}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(words, pairs)


def truncate_at_sentence(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut behind the last sentence end in the second half if there is one."""

    def cut(head: Column, back: Column) -> Column:
        at = F.length(head) - F.length(F.regexp_extract(back, rf"^([^\n{SENTENCE_ENDS}]*)[\n{SENTENCE_ENDS}]", 1))
        return strip(F.when(back.rlike(rf"[\n{SENTENCE_ENDS}]") & (at - 1 >= most // 2), F.left(head, at)).otherwise(head))

    shortened = lambda own: let(F.substring(own, 1, most), lambda head: let(F.reverse(head), lambda back: cut(head, back)))
    return let(c, lambda own: F.when(F.length(own) <= most, own).otherwise(shortened(own)))


def safe_name(c: Column) -> Column:
    clean = strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))
    return F.when(is_blank(clean), "report.txt").otherwise(clean)


def human_size(c: Column, largest: str = "TB") -> Column:
    """Bytes as B, or with one decimal as KB to the largest unit."""
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    units = SIZE_UNITS[: SIZE_UNITS.index(largest) + 1]
    shown = lambda i: F.format_string(f"%.1f {units[i - 1]}", F.bround(c / 1024**i, 1))
    for i in range(1, len(units)):
        out = out.when(c < 1024 ** (i + 1), shown(i))
    return out.otherwise(shown(len(units)))


def brief(c: Column, most: int = 24) -> Column:
    """One line of a note: line breaks become spaces, longer text ends in an ellipsis."""
    flat = strip(F.regexp_replace(c, r"[\r\n]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def shortened(c: Column, most: int = 6000, tail: int = 1000) -> Column:
    """Long tool results keep their head and tail, with the number of characters left out between."""
    n = F.length(c)
    note = F.concat(F.lit("\n[... "), (n - most).cast("string"), F.lit(" characters left out ...]\n"))
    return F.when(n <= most, c).otherwise(F.concat(F.left(c, F.lit(most - tail)), note, F.right(c, F.lit(tail))))


def markdown_table(rows: Column) -> Column:
    """A table (array of rows of cells) as Markdown: blank rows go, rows are filled to the widest, the first is the head."""
    cell = lambda x: strip(F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\n", " "), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def table(full: Column, width: Column) -> Column:
        padded = F.transform(full, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = F.array(line(F.array_repeat(F.lit("---"), width)))
        return F.array_join(F.concat(F.slice(padded, 1, 1), rule, F.slice(padded, 2, F.greatest(F.size(full) - 1, F.lit(0)))), "\n")

    full = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda x: x != ""))
    made = lambda own: F.when(F.size(own) > 0, let(F.array_max(F.transform(own, F.size)), lambda width: table(own, width))).otherwise("")
    return let(full, made)


def citations(c: Column) -> Column:
    """Distinct paragraph numbers of the citation marks [原文位置：n, n], in order."""
    marks = F.regexp_extract_all(c, F.lit(r"\[原文位置[：:]([^\]]*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


def without_citations(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\[原文位置[：:][^\]]*\]|【段落[0-9]+】|【片段[0-9]+/[0-9]+】", ""))


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    """A whole number within bounds; what is no number is the default."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def json_list(c: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_map(c: Column) -> Column:
    """A JSON object of strings; anything else is empty."""
    return F.coalesce(F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def without_key(c: Column, key: str) -> Column:
    """JSON text of an object without a key; text that is no JSON stays."""
    return F.when(F.try_parse_json(c).isNull(), c).otherwise(F.to_json(F.map_filter(json_map(c), lambda k, _: k != key)))


def relative_path(c: Column, base: str) -> Column:
    """A path below base without it, with slashes."""
    slashed = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(base.rstrip("/") + "/"), F.substring(slashed, len(base.rstrip("/")) + 2, 1 << 30)).otherwise(slashed)


def absolute_path(c: Column, base: str) -> Column:
    """A path that isn't absolute, below base."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def error_code(fault: Column) -> Column:
    out = F.lit(1)
    for name, code in ERROR_CODES.items():
        out = F.when(fault == name, code).otherwise(out)
    return out


def percent(part: Column, total: Column) -> Column:
    """With one decimal; 0 of nothing."""
    return F.when(total == 0, 0.0).otherwise(F.round(100.0 * part / total, 1))


def slices(items: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size`` items."""
    if size <= 0:
        raise ValueError("slices need a size above 0")
    starts = lambda own: F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return let(items, lambda own: F.transform(starts(own), lambda i: F.slice(own, i, F.lit(size))))


def overridden(base: Column, over: Column) -> Column:
    """A map with the values of another for the keys that both have."""
    return F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e["key"], F.coalesce(F.element_at(over, e["key"]), e["value"]))))


def clean_keywords(words: Column) -> Column:
    """Stripped words that aren't blank, at most KEYWORDS_AT_MOST."""
    return F.slice(F.filter(F.transform(words, strip), lambda w: F.coalesce(w != "", F.lit(False))), 1, KEYWORDS_AT_MOST)


def asked_only(parsed: Column, asked: Column) -> Column:
    """Of a map of texts, those that are asked for and not blank."""
    return F.map_filter(parsed, lambda k, v: F.array_contains(asked, k) & ~is_blank(v))
