"""Scalar operators P1 to P13. All are built from Spark expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it: an expression inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_tokens(text: Column | str) -> Column:
    """A quarter of the code points, rounded down; null text has no tokens."""
    return F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / 4).cast("int")


def tag_page(text: Column | str, page: Column | str, sep: str = "\n\n") -> Column:
    """Page text between two tags that carry its number."""
    tag = F.concat(F.lit("<physical_index_"), _col(page).cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), F.coalesce(_col(text), F.lit("")), F.lit("\n"), tag, F.lit(sep))


def normalize_leaders(text: Column | str) -> Column:
    """Five or more dots, plain or spaced, become a colon and a space."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


#: Numbers of pages beyond it count as it: no document has such a page.
LARGEST = 2147483647


def _number(digits: Column) -> Column:
    """An integer from a string of digits of any length, LARGEST at most; null if it is empty."""
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(F.length(short) > 10, F.lit(LARGEST)).when(short != "", F.least(short.try_cast("long"), F.lit(LARGEST).cast("long"))).cast("int")


def parse_physical_index(raw: Column | str, bare_int: bool = False) -> Column:
    """The number of `<physical_index_7>` or `physical_index_7`, of `7` too if bare_int; anything else is null."""
    c = F.trim(_col(raw))
    tagged = F.regexp_extract(c, r"^<?physical_index_([0-9]+)>?$", 1)
    bare = F.regexp_extract(c, r"^([0-9]+)$", 1) if bare_int else F.lit("")
    return F.coalesce(_number(tagged), _number(bare))


def parse_page_number(raw: Column | str) -> Column:
    """A printed page as an integer, null if it is none."""
    c = F.trim(_col(raw))
    number = _number(F.regexp_extract(c, r"^[+-]?([0-9]+)$", 1))
    return F.when(c.startswith("-"), -number).otherwise(number)


def parse_page_ranges(spec: Column | str) -> Column:
    """struct(ranges, error) of '3', '5-7' or '3,8,12': (first, last) of each part, or what is wrong with the first bad part."""
    parts = F.transform(F.split(F.coalesce(_col(spec), F.lit("")), ","), lambda x: F.trim(x))
    low = lambda p: _number(F.regexp_extract(p, r"^([0-9]+)(?:\s*-\s*[0-9]+)?$", 1))
    high = lambda p: _number(F.regexp_extract(p, r"^[0-9]+\s*-\s*([0-9]+)$", 1))
    bounds = F.transform(parts, lambda p: F.struct(p.alias("part"), low(p).alias("first"), F.coalesce(high(p), low(p)).alias("last")))
    wrong = F.transform(
        F.filter(bounds, lambda x: x["first"].isNull() | (x["first"] > x["last"])),
        lambda x: F.when(x["first"].isNull(), F.concat(F.lit("not a page: '"), x["part"], F.lit("'"))).otherwise(F.concat(F.lit("start after end: '"), x["part"], F.lit("'"))),
    )
    error = F.try_element_at(wrong, F.lit(1))
    ranges = F.transform(bounds, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    return F.struct(F.when(error.isNull(), ranges).alias("ranges"), error.alias("error"))


def pages_of_ranges(ranges: Column, last_page: Column) -> Column:
    """The sorted distinct pages of (first, last) ranges, as far as last_page: a range of any length makes no more pages than there are."""
    clipped = F.filter(F.transform(ranges, lambda x: F.struct(x["first"].alias("first"), F.least(x["last"], last_page).alias("last"))), lambda x: x["first"] <= x["last"])
    return F.sort_array(F.array_distinct(F.flatten(F.transform(clipped, lambda x: F.sequence(x["first"], x["last"])))))


def parse_page_spec(spec: Column | str, last_page: Column | str) -> Column:
    """struct(pages, error): the sorted distinct pages that a specification names, no further than last_page; see parse_page_ranges."""
    read = parse_page_ranges(spec)
    return F.struct(pages_of_ranges(read["ranges"], _col(last_page)).alias("pages"), read["error"].alias("error"))


def clean_page_list(pages: Column | str) -> Column:
    """Pages from 1 on, each once, in the order given."""
    return F.array_distinct(F.filter(_col(pages), lambda x: x >= 1))


def doc_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def safe_name(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), "/", "-")


def doc_stem(path: Column | str) -> Column:
    """The last part of a path, lower-cased, without its last ending."""
    return F.lower(F.regexp_replace(doc_name(path), r"\.[^.]*$", ""))


def source_path(name: Column | str) -> Column:
    """name with `.pdf` added unless it ends so."""
    c = _col(name)
    return F.when(F.lower(c).endswith(".pdf"), c).otherwise(F.concat(c, F.lit(".pdf")))


def clean_json(text: Column | str) -> Column:
    """JSON of a model's answer: out of its fence, None as null, white space collapsed. See `repair_json`."""
    c = _col(text)
    inner = F.when(c.contains("```json"), F.regexp_extract(c, r"(?s)```json(.*?)(?:```[^`]*)?$", 1)).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "None", "null"), r"\s+", " "))


def repair_json(text: Column | str) -> Column:
    """Trailing commas taken out; for text that does not parse as it is."""
    return F.replace(F.replace(_col(text), F.lit(",]"), F.lit("]")), F.lit(",}"), F.lit("}"))


def read_json(text: Column | str, schema: str) -> Column:
    """A model's answer by schema, repaired only if it does not parse, null if that fails too."""
    clean = clean_json(text)
    # Text that is no JSON object parses to a struct of nulls, so parsing is asked for on its own.
    valid = lambda c: c.startswith("{") & F.get_json_object(c, "$").isNotNull()
    fixed = repair_json(clean)
    return F.when(valid(clean), F.from_json(clean, schema)).when(valid(fixed), F.from_json(fixed, schema))


def parent_code(code: Column | str) -> Column:
    """The code above a dotted one: 1.2 of 1.2.3; null for top-level, empty and null codes."""
    return F.nullif(F.regexp_extract(_col(code), r"^(.*)\.[^.]*$", 1), F.lit(""))
