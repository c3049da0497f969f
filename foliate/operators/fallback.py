"""What stands in for sections that no heading opens: an abstract, spans behind telling words, the end of a text.

All of it is told within a text's row: lines are structs that say what they are, and each rule is a condition on a line and the few
lines around it, so that a rule's lines are a filter of a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import cleaning as cl
from foliate.operators import structure as st

#: Telling words of methods and of innovations, headings of a conclusion within a line, begin and end of an abstract, lines that
#: look like titles, marks that labels don't have, and ends of sentences (fixed values).
METHOD = r"研究?方法|采用.{0,12}(?:方法|案例|分析)|案例(?:分析|研究)|实证(?:研究|分析)|实验|问卷|访谈|数据(?:采集|来源)|分析框架|设计实践|研究设计"
INNOVATION = r"创新|新颖|首次|突破点|设计思路|本文提出|提出了?一种"
CONCLUSION = r"(?:[一二三四五六七八九十]+\s*[、.．]|[（(]\s*[一二三四五六七八九十]+\s*[）)])\s*(?:结\s*语|结\s*论|总\s*结)"
ABSTRACT = r"^\s*摘\s*要\s*[:：]?\s*"
ABSTRACT_ENDS = r"(?i)^\s*(?:关\s*键\s*词\s*[:：]?|中图分类号|文献标识码|文章编号|Abstract\b)"
TITLE = r"^[^。！？，,；;：:、…]{4,22}$"
LABEL, SENTENCE, HAN = r"[。！？，,；;：:、（）()\d]", "[。！？]", "[一-鿿]"
#: Characters of a filled section by precision; lines of an abstract, of spans and on either side of a conclusion's heading; lines
#: left out behind that; first lines that may be titles; lengths of headings, labels, running lines, backgrounds, telling and last lines (fixed values).
CAPS, ABSTRACT_LINES, SPAN, SHORT_SPAN, END_LINES, LEFT_OUT, TITLES = {3: 600, 4: 900, 5: 1200}, 14, 4, 3, 12, 4, 6
HEADING_LENGTH, LABEL_LENGTH, RUNNING, LEAST = 30, 15, 10, 20

_PICK = "array<struct<i:int,s:string>>"


def told_lines(lines: Column) -> Column:
    """The lines of a text that aren't blank (i: number, s: stripped), and what each one is."""

    def told(x: Column, i: Column) -> Column:
        return tx.let(tx.strip(x), lambda s: tx.let(cl.without_footnote(s), lambda bare: tx.let(first(s, bare), lambda own: marks(s, bare, own, i))))

    def first(s: Column, bare: Column) -> Column:
        """What several marks are made of."""
        found = {"noise": cl.is_noise(s), "title": s.rlike(TITLE), "numbered": s.rlike(cl.NUMBERED), "abstract": s.rlike(ABSTRACT), "han": bare.rlike(HAN), "n": F.length(s), "m": F.length(bare)}
        return F.struct(*(c.alias(name) for name, c in found.items()))

    def marks(s: Column, bare: Column, own: Column, i: Column) -> Column:
        n, noise, title, numbered = (own[name] for name in ("n", "noise", "title", "numbered"))
        heads = numbered & (n <= HEADING_LENGTH)
        is_what = {
            "noise": noise,
            "title": title,
            "numbered": numbered,
            "stops": noise | heads,
            "runs": ~noise & ~title & ~heads & (n >= RUNNING),
            "tail": noise | ((n <= LABEL_LENGTH) & ~s.rlike(LABEL)),
            "method": ~noise & s.rlike(METHOD) & ((n >= LEAST) | numbered),
            "innovation": ~noise & (n >= LEAST) & s.rlike(INNOVATION),
            "concludes": s.rlike(CONCLUSION),
            "abstract": own["abstract"],
            "abstract_ends": ~own["abstract"] & (s.rlike(ABSTRACT_ENDS) | s.rlike(cl.META)),
            "usable": (own["m"] >= 4) & own["han"],
            "bare_noise": cl.is_noise(bare),
            "last": ~noise & (own["m"] >= LEAST) & own["han"],
        }
        return F.struct(i.alias("i"), s.alias("s"), bare.alias("bare"), *(c.alias(name) for name, c in is_what.items()))

    return F.filter(F.transform(lines, told), lambda x: x["s"] != "")


def window(lines: Column, at: Column, size: int) -> Column:
    """So many lines from a place (0 on), fewer at the end."""
    return F.slice(lines, at + 1, F.lit(size))


def up_to(own: Column, o: Column) -> Column:
    """The lines of a window up to place o, itself included."""
    return F.slice(own, F.lit(1), o + 1)


def first_place(lines: Column, what: str) -> Column:
    """Where the first line is that the mark holds for; -1 where none is."""
    return (F.array_position(F.transform(lines, lambda x: x[what]), F.lit(True)) - 1).cast("int")


def as_written(lines: Column, by: str = "s") -> Column:
    return F.transform(lines, lambda x: F.struct(x["i"].alias("i"), x[by].alias("s"))).cast(_PICK)


def span(body: Column, at: Column, size: int) -> Column:
    """Lines from a place on. No line behind one that stops is in it, nor one behind a gap of lines; a numbered line at
    its head allows one gap."""

    def within(own: Column) -> Column:
        apart = lambda o: F.size(F.filter(F.sequence(F.lit(1), o), lambda j: F.get(own, j)["i"] - F.get(own, j - 1)["i"] > 1))
        allowed = F.when(F.get(own, F.lit(0))["numbered"], 1).otherwise(0)
        stopped = lambda o: F.exists(F.slice(own, F.lit(2), o), lambda y: y["stops"])
        return F.filter(own, lambda x, o: F.when(o == 0, True).otherwise(~stopped(o) & (apart(o) <= allowed)))

    return tx.let(window(body, at, size), within)


def abstract(lines: Column) -> Column:
    """The lines of the first abstract up to one that ends it, its mark taken off; none without one."""

    def within(own: Column) -> Column:
        kept = F.filter(own, lambda x, o: ~F.exists(up_to(own, o), lambda y: y["abstract_ends"]))
        bare = F.transform(kept, lambda x: F.struct(x["i"].alias("i"), tx.strip(F.regexp_replace(x["s"], ABSTRACT, "")).alias("s")))
        return F.filter(bare, lambda x: x["s"] != "").cast(_PICK)

    at = first_place(lines, "abstract")
    return F.when(at >= 0, tx.let(window(lines, at, ABSTRACT_LINES), within)).otherwise(F.array().cast(_PICK))


def behind(lines: Column, mark: Column, cap: int) -> Column:
    """Usable lines after a conclusion's heading: before noise, before more than some unusable ones, before the text is long enough."""

    def within(own: Column) -> Column:
        def stays(x: Column, o: Column) -> Column:
            before = F.slice(own, F.lit(1), o)
            left_out = F.size(F.filter(before, lambda y: ~y["usable"]))
            long = F.aggregate(before, F.lit(0), lambda n, y: n + F.when(y["usable"], F.length(y["bare"])).otherwise(0))
            noisy = F.exists(up_to(own, o), lambda y: y["usable"] & y["bare_noise"])
            return x["usable"] & ~noisy & (left_out <= LEFT_OUT) & (long < cap)

        return as_written(F.filter(own, stays), "bare")

    return tx.let(window(lines, mark + 1, END_LINES), within)


def before(lines: Column, mark: Column) -> Column:
    """The nearest run of running lines ahead of a conclusion's heading, lines of the text's tail left out: unbroken, without a blank line."""

    def within(own: Column) -> Column:
        # own ends with the run's last line; a line is in the run where all from it on are, and stand line by line
        end = F.element_at(own, -1)["i"]
        rest = lambda o: F.slice(own, o + 1, F.size(own) - o)
        return as_written(F.filter(own, lambda x, o: (end - x["i"] == F.size(own) - 1 - o) & F.forall(rest(o), lambda y: y["runs"])))

    ahead = F.slice(lines, F.lit(1), mark)
    last = F.array_max(F.transform(ahead, lambda x, o: F.when(~x["tail"], o)))
    first = F.greatest(last - (END_LINES - 1), F.lit(0))
    return F.when(last.isNotNull(), tx.let(F.slice(lines, first + 1, last - first + 1), within)).otherwise(F.array().cast(_PICK))


def conclusion(lines: Column, cap: int) -> Column:
    """What stands on both sides of a heading of a conclusion within a line; without that the last running line."""
    sides = tx.let(first_place(lines, "concludes"), lambda mark: F.when(mark >= 0, F.concat(behind(lines, mark, cap), before(lines, mark))).otherwise(F.array().cast(_PICK)))
    last = F.slice(F.reverse(F.filter(lines, lambda x: x["last"])), 1, 1)
    return tx.let(sides, lambda found: F.when(F.size(found) > 0, found).otherwise(as_written(last, "bare")))


def joined(picked: Column, cap: int) -> Column:
    """Picked lines as one text of at most cap characters."""
    return tx.truncate_at_sentence(cl.unwrapped(F.array_join(F.transform(picked, lambda x: x["s"]), "\n")), cap)


def background(lines: Column, body: Column, cap: int) -> Column:
    """The abstract; without one the first span that holds a sentence and isn't short. Spans are joined only until one fits."""
    may_open = F.transform(body, lambda x, k: F.when(~x["noise"] & ~((k < TITLES) & x["title"]), k))

    def fitting(own: Column) -> Column:
        return tx.let(joined(own, cap), lambda c: F.when((F.length(c) >= LEAST) & c.rlike(SENTENCE), own))

    def first(best: Column, k: Column) -> Column:
        return F.when(best.isNotNull(), best).otherwise(tx.let(as_written(span(body, k, SPAN)), fitting)).cast(_PICK)

    spans = F.aggregate(F.filter(may_open, lambda k: k.isNotNull()), F.lit(None).cast(_PICK), first)
    return tx.let(abstract(lines), lambda own: F.when(F.size(own) > 0, own).otherwise(spans))


def core(body: Column) -> Column:
    """The lines of the middle that are neither noise nor titles."""
    middle = F.when(F.size(body) > 2, F.slice(body, F.lit(2), F.size(body) - 2)).otherwise(body)
    return as_written(F.filter(middle, lambda x: ~x["noise"] & ~x["title"]))


def telling(body: Column, what: str, size: int) -> Column:
    """The span from the first line on that the mark holds for."""
    return tx.let(first_place(body, what), lambda at: F.when(at >= 0, as_written(span(body, at, size))).otherwise(F.array().cast(_PICK)))


def fill(lines: Column, body: Column, cap: int) -> dict[str, Column]:
    """The lines that stand in for each dimension."""
    return {
        "research_background": background(lines, body, cap),
        "core_view": core(body),
        "research_method": telling(body, "method", SPAN),
        "innovation_point": telling(body, "innovation", SHORT_SPAN),
        "research_conclusion": conclusion(lines, cap),
    }


def filled_sections(docs: DataFrame, precision: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, dimension, content, lines, filled): the sections of each text; from precision 3 on those that are missing
    or empty are filled from its lines (their numbers in ``lines``), cut at a sentence end. Dimensions that nothing stands
    in for have no row. Null and empty texts have none; rows of one key are texts of their own.
    """
    at = st.opened(docs, key, text)
    own = st.sections_of(F.col("lines"), F.col("opens"))
    found = F.transform(F.filter(own, lambda s: ~tx.is_blank(s["content"])), lambda s: F.struct(s["dimension"].alias("dimension"), s["content"].alias("content"), F.array().cast("array<int>").alias("lines"), F.lit(False).alias("filled")))
    if precision < min(CAPS):
        return at.select(key, F.explode(found).alias("s")).select(key, "s.*")
    cap = CAPS[min(precision, max(CAPS))]
    references = F.get(F.filter("opens", lambda h: h["dimension"] == "reference_list"), F.lit(0))["line"]

    def made(have: Column, lines: Column, body: Column) -> Column:
        names = F.transform(have, lambda s: s["dimension"])
        picked = F.array(*(F.struct(F.lit(dimension).alias("dimension"), F.when(~F.array_contains(names, dimension), own).alias("own")) for dimension, own in fill(lines, body, cap).items()))
        some = F.filter(picked, lambda s: F.coalesce(F.size(s["own"]) > 0, F.lit(False)))
        filled = F.transform(some, lambda s: F.struct(s["dimension"].alias("dimension"), joined(s["own"], cap).alias("content"), F.transform(s["own"], lambda x: x["i"]).alias("lines"), F.lit(True).alias("filled")))
        return F.concat(have, F.filter(filled, lambda s: ~tx.is_blank(s["content"])))

    def of_lines(have: Column, lines: Column) -> Column:
        ahead = F.filter(lines, lambda x: references.isNull() | (x["i"] < references))
        return tx.let(F.when(F.size(ahead) > 0, ahead).otherwise(lines), lambda body: made(have, lines, body))

    whole = tx.let(found, lambda have: tx.let(told_lines(F.col("lines")), lambda lines: of_lines(have, lines)))
    return at.select(key, F.explode(whole).alias("s")).select(key, "s.*")
