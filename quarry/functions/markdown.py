"""Markdown expressions: reading titles, sources, bodies and tables out of documents, and rendering them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lines and headings of a stored document. Only \n ends a line, as in SQL; by itself Java takes \r, U+0085, U+2028 and U+2029 too.
BLANK, INK = r"[ \t\n\f\r]", r"[^ \t\n\f\r]"
HEADER = rf"(?md)^##{BLANK}+([^\n]+)"
META = rf"(?md)^\*Source:{BLANK}*(.*?){BLANK}*\|{BLANK}*(.*?){BLANK}*\|{BLANK}*Category:"
REFERENCES = "\n## References\n"
NO_BODY = "(No content available)"


def _stripped(text: Column) -> Column:
    return F.regexp_extract(text, rf"\A{BLANK}*+((?s:.*){INK})?", 1)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def title(md: Column) -> Column:
    """What follows the first ``: `` of the first header, else the header; null without one, or where nothing follows."""
    header = F.regexp_extract(md, HEADER, 1)
    at = F.instr(header, ": ")
    return _some(_stripped(F.when(at > 0, F.substring(header, at + 2, F.length(header))).otherwise(header)))


def source(md: Column) -> Column:
    return _some(F.regexp_extract(md, META, 1))


def published(md: Column) -> Column:
    return _some(F.regexp_extract(md, META, 2))


def body(md: Column) -> Column:
    """What follows the source line, without the references; the whole text without a source line. References stand
    last, so that a heading of that name inside a body does not end it."""
    rest = F.regexp_extract(md, rf"\A(?:(?s:.*?){META})?+{BLANK}*+((?s:.*){INK})?", 3)
    return F.coalesce(_stripped(F.regexp_replace(rest, rf"(?s)\A(.*){REFERENCES}.*", "$1")), F.lit(""))


def headline(md: Column) -> Column:
    """Of a first line that is a header: what follows its colon, else all of it; else empty."""
    first = F.substring_index(md, "\n", 1)
    said = _stripped(F.substring(first, 4, F.length(first)))
    said = F.when(F.instr(said, ":") > 0, _stripped(F.substring(said, F.instr(said, ":") + 1, F.length(said)))).otherwise(said)
    return F.when(first.startswith("## "), said).otherwise("")


def snippet(md: Column, most: int = 200) -> Column:
    """The first characters of the text, its headline aside."""
    rest = F.when(F.instr(md, "\n") > 0, F.substring(md, F.instr(md, "\n") + 1, F.length(md))).otherwise("")
    return F.substring(_stripped(F.when(headline(md) != "", rest).otherwise(md)), 1, most)


def news_lines(md: Column) -> tuple[Column, Column]:
    """The last header before the first source line (or of all), and the first source line, without their marks."""
    lines = F.transform(F.split(md, "\n"), _stripped)
    place = F.array_position(F.transform(lines, lambda x: x.startswith("*Source:")), True)
    headers = lambda some: F.filter(some, lambda x: x.startswith("## "))
    # Reading ends at the first line by which there are both; headers before the source line count to the last.
    first_header = F.array_position(F.transform(lines, lambda x: x.startswith("## ")), True)
    before = headers(F.slice(lines, 1, F.greatest(place, F.lit(1)).cast("int")))
    shown = F.when(place == 0, F.element_at(headers(lines), -1)).when(first_header < place, F.element_at(before, -1)).otherwise(F.get(headers(lines), 0))
    said = F.when(place > 0, F.regexp_replace(F.get(lines, (place - 1).cast("int")), r"^[* ]+|[* ]+$", "")).otherwise("")
    return F.coalesce(_stripped(F.substring(shown, 4, F.length(shown))), F.lit("")), said


def table_metrics(md: Column) -> Column:
    """A map of the lines of a table that have exactly two cells; the last of a name counts."""
    marked = lambda x: (F.instr(x, "|") > 0) & (F.instr(x, "---") == 0) & (F.instr(x, "Field") == 0)
    cells = F.transform(F.filter(F.split(md, "\n"), marked), lambda x: F.transform(
        F.filter(F.split(_stripped(x), r"\|"), lambda c: _stripped(c) != ""), _stripped))
    two = F.filter(cells, lambda c: F.size(c) == 2)
    last = F.filter(two, lambda c, i: ~F.exists(F.slice(two, i + 2, F.size(two)), lambda x: F.get(x, 0) == F.get(c, 0)))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(F.get(c, 0), F.get(c, 1))))


def flat_table(values: Column) -> Column:
    """A map of texts as a table of fields and values, sorted by field; empty for an empty map."""
    rows = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), F.coalesce(e["value"], F.lit("None")), F.lit(" |")))
    return F.when(F.size(values) > 0, F.concat(F.lit("| Field | Value |\n|---|---|\n"), F.array_join(rows, "\n"))).otherwise("")


def nested_table(values: Column) -> Column:
    """A map of maps of texts as a table: sorted rows by sorted columns, blank where a row lacks one."""
    columns = F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values(values), F.map_keys))))
    head = F.concat(F.lit("| Metric | "), F.array_join(columns, " | "), F.lit(" |\n|---|"), F.array_join(F.transform(columns, lambda _: F.lit("---")), "|"), F.lit("|\n"))
    rows = F.transform(F.array_sort(F.map_keys(values)), lambda k: F.concat(
        F.lit("| "), k, F.lit(" | "), F.array_join(F.transform(columns, lambda c: F.coalesce(F.try_element_at(F.try_element_at(values, k), c), F.lit(""))), " | "), F.lit(" |")))
    return F.when(F.size(values) > 0, F.concat(head, F.array_join(rows, "\n"))).otherwise("")


def render_news(articles: Column, ticker: Column) -> Column:
    """Markdown of an array of articles (title, source, publisher, published, url, article_url, content, description),
    the first of each alternative that isn't empty counting, with numbered references."""
    pick = lambda *c: F.coalesce(*map(_some, c))

    def section(a):
        name = F.coalesce(a["title"], F.lit("Untitled"))
        head = F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.lit("## "), ticker, F.lit(": "), name)).otherwise(F.concat(F.lit("## "), name))
        meta = F.concat(F.lit("*Source: "), F.coalesce(pick(a["source"], a["publisher"]), F.lit("Unknown")), F.lit(" | "), F.coalesce(a["published"], F.lit("")), F.lit(" | Category: news*"))
        return F.concat(head, F.lit("\n"), meta, F.lit("\n\n"), F.coalesce(pick(a["content"], a["description"]), F.lit(NO_BODY)))

    def reference(a, i):
        url = pick(a["url"], a["article_url"])
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), url, F.lit(": "), F.coalesce(a["title"], F.lit("Untitled")))

    references = F.filter(F.transform(articles, reference), lambda x: x.isNotNull())
    tail = F.when(F.size(references) > 0, F.concat(F.lit("\n" + REFERENCES), F.array_join(references, "\n"))).otherwise("")
    return F.concat(F.array_join(F.transform(articles, section), "\n\n"), tail)


def render_statements(statements: Column, ticker: Column) -> Column:
    """Markdown of an array of statements (name, values: a map of texts), a table each."""
    def section(x):
        named = F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.lit("## "), ticker, F.lit(" Fundamentals — "), x["name"])).otherwise(F.concat(F.lit("## "), x["name"]))
        return F.concat(named, F.lit("\n\n"), flat_table(x["values"]))

    return F.array_join(F.transform(statements, section), "\n\n")


def render_pairs(values: Column, ticker: Column) -> Column:
    """Markdown of an array of (key, value), a line each."""
    head = F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.lit("## "), ticker, F.lit(" Data"))).otherwise("## Data")
    lines = F.transform(values, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), F.coalesce(e["value"], F.lit("None"))))
    return F.array_join(F.concat(F.array(head), lines), "\n")
