"""Rules R1 to R7: judgements about pages and titles as plain column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .scalars import _col, _number, let

#: Headings of tables of contents.
CONTENTS = "table of contents|contents|table des matières|sommaire|inhaltsverzeichnis|inhalt|índice|contenido"
HEADER_LINE = rf"(?i)^[ \t]*(?:{CONTENTS})[ \t]*$"
_HEADER = rf"(?im)^[ \t]*(?:{CONTENTS})[ \t]*$"
_LEADER_LINE = r"(?m)^.*(?:\.{5,}|(?:\. ){5,}\.?)[ \t]*[0-9]+[ \t]*$"
_CODE = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+"
_ENDS_IN_PAGE = r"[: \t][ \t]*([0-9]+)[ \t]*$"


def is_toc_page(text: Column | str) -> Column:
    """A line that is only a contents heading, or three lines with leaders and a page."""
    c = F.coalesce(_col(text), F.lit(""))
    # Without leaders no line is tried, which would look at each of its characters anew.
    leaders = F.contains(c, F.lit("." * 5)) | F.contains(c, F.lit(". " * 5))
    return c.rlike(_HEADER) | F.when(leaders, F.size(F.regexp_extract_all(c, F.lit(_LEADER_LINE), F.lit(0))) >= 3).otherwise(False)


def entry_lines(content: Column | str) -> Column:
    """Lines of a table of contents that are neither blank nor its heading."""
    lines = F.split(F.coalesce(_col(content), F.lit("")), "\n")
    return F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(HEADER_LINE))


def has_page_numbers(content: Column | str) -> Column:
    """R2: at least half of the entries, and one, end in an integer."""
    lines = entry_lines(content)
    numbered = F.size(F.filter(lines, lambda x: x.rlike(_ENDS_IN_PAGE)))
    return (numbered > 0) & (2 * numbered >= F.size(lines))


def parse_toc_lines(content: Column | str) -> Column:
    """Array of (structure, title, page) of the entries, after `normalize_leaders`. Pages may have any number of digits; see LARGEST."""

    def entry(line: Column) -> Column:
        page = _number(F.regexp_extract(line, _ENDS_IN_PAGE, 1))
        rest = F.regexp_replace(line, r"[: \t]+[0-9]+[ \t]*$", "")
        return F.struct(F.nullif(F.regexp_extract(rest, _CODE, 1), F.lit("")).alias("structure"), F.trim(F.regexp_replace(rest, _CODE, "")).alias("title"), page.alias("page"))

    return F.filter(F.transform(entry_lines(content), entry), lambda x: x["title"] != "")


def squash(text: Column | str) -> Column:
    """Lower case, without white space; to look for each kind of it costs less than `translate`, as text has few kinds."""
    c = F.lower(_col(text))
    for x in " \t\n\x0b\f\r":
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def squashed_line(line: Column | str) -> Column:
    """A line as it would match a title: its leading code and its white space gone."""
    return squash(F.regexp_replace(_col(line), _CODE, ""))


def title_appears(title: Column | str, text: Column | str) -> Column:
    """struct(appears, at_start); an empty or null title or a null text never appears. A leading code of the text is passed over."""
    t, body = squash(F.coalesce(_col(title), F.lit(""))), F.coalesce(_col(text), F.lit(""))
    # What is squashed behind the code is the end of what is squashed, so the text is squashed once.
    code = F.length(squash(F.regexp_extract(body, _CODE, 0)))

    def judged(x: Column) -> Column:
        start = (x["t"] != "") & (F.startswith(x["body"], x["t"]) | (F.substring(x["body"], x["code"] + 1, F.length(x["t"])) == x["t"]))
        there = (x["t"] != "") & F.contains(x["body"], x["t"])
        return F.struct((there | start).alias("appears"), start.alias("at_start"))

    return let(F.struct(t.alias("t"), squash(body).alias("body"), code.alias("code")), judged)


def may_be_heading(line: Column) -> Column:
    """Whether a line begins as one that `heading` knows: a test of one character that spares most lines its patterns."""
    return F.left(F.ltrim(line, F.lit(" \t")), F.lit(1)).isin(*"0123456789#cCsSpP")


def heading(line: Column) -> Column:
    """R4 for one line: struct(structure, title, level), null if it is no heading.

    A dotted number and at most twelve words; `Chapter 3` and the like; a markdown heading, whose level is set
    and whose structure comes from the headings before it.
    """
    numbered = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+([^ \t]+(?:[ \t]+[^ \t]+){0,11})[ \t]*$"
    chapter = r"(?i)^[ \t]*(?:chapter|section|part)[ \t]+([0-9]+)(?:[.: \t].*)?$"
    marked = r"^(#{1,6})[ \t]+(.*[^ \t])[ \t]*$"
    leader = line.rlike(r"(?:\.{5,}|(?:\. ){5,}\.?)[ \t]*[0-9]*[ \t]*$")
    none = F.lit(None).cast("int")
    return (
        F.when(leader, None)
        .when(line.rlike(numbered), F.struct(F.regexp_extract(line, numbered, 1).alias("structure"), F.regexp_extract(line, numbered, 2).alias("title"), none.alias("level")))
        .when(line.rlike(chapter), F.struct(F.regexp_extract(line, chapter, 1).alias("structure"), F.trim(line).alias("title"), none.alias("level")))
        .when(line.rlike(marked), F.struct(F.lit(None).cast("string").alias("structure"), F.regexp_extract(line, marked, 2).alias("title"), F.length(F.regexp_extract(line, marked, 1)).alias("level")))
    )


def clip(text: Column | str, n: int) -> Column:
    """The first n characters, cut after the last whole word; all of a shorter text."""
    c = F.coalesce(_col(text), F.lit(""))
    head = F.substring(c, 1, n)
    word = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.length(c) <= n, F.trim(c)).when(F.substring(c, n + 1, 1).rlike(r"\s"), F.trim(head)).otherwise(F.when(word == "", head).otherwise(word))


_LAST_WORD = re.compile(r"(?s)(.*\S)\s+\S*\Z", re.ASCII)


def clipped(text: str | None, n: int) -> str:
    """What `clip` makes of a text, for passes in Python."""
    text = text or ""
    if len(text) <= n:
        return text.strip(" ")
    head = text[:n]
    if text[n] in " \t\n\x0b\f\r":
        return head.strip(" ")
    word = _LAST_WORD.match(head)
    return word[1] if word else head
