"""Entries to physical pages: pairs, offsets, samples, groups and windows of pages, neighbours, titles in text."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..functions.scalars import LARGEST, tag_page
from ..sources.scratch import cut
from .folds import folded
from .membership import likely_members
from .pages import Pages, block_of
from .requests import Answers


def _bounded(number: Column) -> Column:
    """A long as an int, LARGEST or its negative if it lies beyond: one absurd page number must not end a job."""
    return F.greatest(F.least(number, F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")).cast("int")


def match_title_pairs(toc: DataFrame, located: DataFrame, detection: DataFrame) -> DataFrame:
    """(doc_id, pair_order, title, page, physical_index) of entries and located entries with the same title.

    Only places from the 0-based index after the last contents page on count, which lets that page itself pass.
    Duplicate titles multiply; pair_order counts by the position of the entry, then of the place.
    """
    after = detection.select("doc_id", F.coalesce(F.array_max("toc_pages"), F.lit(0)).alias("_after"))
    places = located.filter("physical_index is not null").select("doc_id", "title", "physical_index", F.col("pos").alias("_lpos"))
    pairs = toc.select("doc_id", "title", "page", "pos").join(places, ["doc_id", "title"]).join(after, "doc_id").filter("physical_index >= _after")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "_lpos")) - 1
    return pairs.select("doc_id", order.alias("pair_order"), "title", "page", "physical_index")


def page_offset(pairs: DataFrame, min_pairs: int = 3) -> DataFrame:
    """A3: (doc_id, offset): the most frequent physical_index - page, the first seen of equals.

    A document needs min_pairs pairs, those without a page included, and one with a page.
    """
    apart = _bounded(F.col("physical_index").cast("long") - F.col("page"))
    enough = pairs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pairs)
    counts = pairs.filter("page is not null").groupBy("doc_id", apart.alias("diff")).agg(F.count("*").alias("n"), F.min("pair_order").alias("first"))
    best = counts.groupBy("doc_id").agg(F.max_by("diff", F.struct("n", -F.col("first"))).alias("offset"))
    return best.join(enough, "doc_id", "left_semi")


def evenly_spaced(items: DataFrame, n: int = 8) -> DataFrame:
    """N items a document, evenly spaced by index with halves to even; all of n or fewer."""
    counts = items.groupBy("doc_id").agg(F.count("*").alias("_n"))
    at = F.when(F.col("_n") <= n, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1)).cast("long")))
    )
    chosen = counts.select("doc_id", F.explode(at).alias("_at"))
    numbered = items.withColumn("_at", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long"))
    return numbered.join(chosen, ["doc_id", "_at"]).drop("_at")


def prefix_within_budget(pages: DataFrame, detection: DataFrame, n: int, budget: int | None) -> DataFrame:
    """(doc_id, page) of the n pages after the contents pages, as far as the token budget goes."""
    after = detection.select("doc_id", F.coalesce(F.array_max("toc_pages"), F.lit(0)).alias("_after"))
    some = pages.select("doc_id", "page", "token_length").join(after, "doc_id").filter((F.col("page") > F.col("_after")) & (F.col("page") <= F.col("_after") + n))
    total = F.sum("token_length").over(Window.partitionBy("doc_id").orderBy("page"))
    some = some.withColumn("_total", total)
    return (some if budget is None else some.filter(F.col("_total") <= budget)).select("doc_id", "page")


def _paged(pages: DataFrame) -> DataFrame:
    """(doc_id, numbers, tokens): each document's page numbers in order and the token counts of these pages."""
    own = F.sort_array(F.collect_list(F.struct("page", "token_length")))
    return pages.groupBy("doc_id").agg(own.alias("_own")).select("doc_id", F.col("_own.page").alias("numbers"), F.col("_own.token_length").alias("tokens"))


def _lists(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column, and the n + 1 offsets of its rows."""
    lists = batch.column(column)
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sums(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])


def _group_bounds(sums: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) page of each group, from running sums of token counts; see group_pages."""
    n, total = len(sums) - 1, int(sums[-1])
    goal = math.ceil((total / math.ceil(total / max_tokens) + max_tokens) / 2)
    # For a group whose first new page is p: where it begins, and where the next one's new pages do.
    begin = np.maximum(np.arange(n) - overlap, 0)
    after = np.maximum(np.searchsorted(sums, sums[begin] + goal, "right") - 1, np.arange(1, n + 1)).tolist()
    bounds, p = [], 0
    while p < n:
        bounds.append((int(begin[p]), after[p]))
        p = after[p]
    return bounds


def group_pages(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1) -> DataFrame:
    """(doc_id, group_no, page): groups of pages of nearly equal token counts that overlap by `overlap` pages.

    A document within max_tokens is one group. Else each group takes new pages, one at least, as far as they and
    the overlap before them stay within a goal halfway between the mean group and max_tokens. Of the text
    nothing moves; a document's page numbers and counts, two integers a page, are one row.
    """

    def run(batches):
        for batch in batches:
            numbers, at = _lists(batch, "numbers")
            tokens = _lists(batch, "tokens")[0].to_numpy()
            doc, group, place = [], [], []
            for d, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                sums = _sums(tokens[low:high])
                bounds = [(0, high - low)] if sums[-1] <= max_tokens else _group_bounds(sums, max_tokens, overlap)
                for g, (first, end) in enumerate(bounds):
                    doc.append(np.full(end - first, d))
                    group.append(np.full(end - first, g, np.int32))
                    place.append(np.arange(low + first, low + end))
            if doc:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(group)), numbers.take(pa.array(np.concatenate(place)))], names=["doc_id", "group_no", "page"])

    return _paged(pages).mapInArrow(run, "doc_id string, group_no int, page int")


def group_text(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, group_no, text) of each group's tagged pages."""
    parts = F.sort_array(F.collect_list(F.struct("page", tag_page("text", "page").alias("t"))))
    return groups.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).groupBy("doc_id", "group_no").agg(parts.alias("_p")).select("doc_id", "group_no", F.array_join("_p.t", "").alias("text"))


def _around(sums: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """First and last page around the middle of pages low to high - 1 within the budget, from running sums of token counts.

    Pages right and left of the middle are added by turns. The number of turns that fit is searched for: their total
    only grows. The side whose turn did not fit is closed; how far the other goes alone is a search in the sums.
    """
    middle = low + (high - low) // 2
    right, left = high - 1 - middle, middle - low
    reach = lambda a, b: int(sums[middle + a + 1] - sums[middle - b])
    turns = bisect_right(range(1, 2 * right + 1), budget, key=lambda k: reach((k + 1) // 2, k // 2))
    a, b = (turns + 1) // 2, turns // 2
    if turns % 2:  # the left side is closed
        a = max(a, min(right, int(np.searchsorted(sums, budget + sums[middle - b], "right")) - 2 - middle))
    else:  # the right side is closed, or has no more pages
        b = max(b, min(left, middle - int(np.searchsorted(sums, sums[middle + a + 1] - budget, "left"))))
    return middle - b, middle + a


def resolve_window(bounds: DataFrame, pages: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, pos, first_page, last_page) to look for each item of bounds (doc_id, pos, prev_index, next_index) in.

    The pages of the range that exist; with a budget, those around the middle one, which always stays, right and
    left by turns as far as the budget goes; a side whose next page does not fit is closed. Items without a page are left out.
    """
    counts = pages.select("doc_id", "page", "token_length")
    if budget is None:
        last = counts.groupBy("doc_id").agg(F.max("page").alias("_last"))
        out = bounds.join(last, "doc_id").select("doc_id", "pos", F.greatest("prev_index", F.lit(1)).alias("first_page"), F.least("next_index", "_last").alias("last_page"))
        return out.filter("first_page <= last_page")

    def run(batches):
        for batch in batches:
            numbers, at = _lists(batch, "numbers")
            numbers, tokens = numbers.to_numpy(), _lists(batch, "tokens")[0].to_numpy()
            items, of = _lists(batch, "items")
            pos, low, high = (items.field(c).to_numpy() for c in ("pos", "prev_index", "next_index"))
            rows = []
            for d in range(batch.num_rows):
                own, sums = numbers[at[d] : at[d + 1]], _sums(tokens[at[d] : at[d + 1]])
                part = slice(of[d], of[d + 1])
                first, end = np.searchsorted(own, np.maximum(low[part], 1), "left"), np.searchsorted(own, high[part], "right")
                for p, i, j in zip(pos[part].tolist(), first.tolist(), end.tolist()):
                    if i < j:
                        a, b = _around(sums, i, j, budget)
                        rows.append((d, p, own[a], own[b]))
            if rows:
                doc, *found = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int32()) for x in found)], names=["doc_id", "pos", "first_page", "last_page"])

    items = bounds.filter("prev_index is not null and next_index is not null").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "prev_index", "next_index")).alias("items"))
    return _paged(counts).join(items, "doc_id").mapInArrow(run, "doc_id string, pos int, first_page int, last_page int")


def neighbour_bounds(items: DataFrame, known: Column, prev_default, next_default) -> DataFrame:
    """Items with prev_index and next_index: the nearest known physical_index before and after in list order."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    index = F.when(known, F.col("physical_index"))
    out = items.withColumns({"prev_index": F.last(index, True).over(before), "next_index": F.first(index, True).over(after)})
    return out.withColumns({"prev_index": F.coalesce("prev_index", prev_default).cast("int"), "next_index": F.coalesce("next_index", next_default).cast("int")})


def ranges_to_pages(ranges: DataFrame, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """Rows of ranges for each page from first to last; none if last is before first."""
    return ranges.filter(F.col(first) <= F.col(last)).withColumn("page", F.explode(F.sequence(F.col(first), F.col(last))))


def pages_in_range(ranges: DataFrame, pages: DataFrame | Pages, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """The pages of each range, by an equi-join on (doc_id, page), or on blocks of stored pages."""
    return Pages.of(pages).in_ranges(ranges, first, last)


def with_range_text(ranges: DataFrame, pages: DataFrame | Pages, key: list[str], labels: bool = False, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """Ranges (key, doc_id, first, last, ..) with text: each range's pages in order, tagged if labels; empty for ranges without pages.

    Pages are gathered by (doc_id, block of PAGE_BLOCK pages), the only exchange of their text, or none if they are stored so; a range goes
    to its block with all its columns and takes its pages there. The text of ranges that lie in several blocks is put
    together by key (unique, with doc_id or another) afterwards. Null ranges have empty text too.
    """
    ranges, pages = ranges.drop("text"), Pages.of(pages)
    body = lambda x: tag_page(x["text"], x["page"], "\n") if labels else x["text"]
    low, high = F.col(first), F.col(last)
    inside = F.filter("_pages", lambda x: (x["page"] >= low) & (x["page"] <= high))
    text = F.when(low <= high, F.array_join(F.transform(inside, body), ""))
    meet = lambda some: pages.meet(some).withColumn("text", F.coalesce(text, F.lit(""))).drop("_pages")
    wide = F.coalesce((low <= high) & (block_of(low) != block_of(high)), F.lit(False))
    one = meet(ranges.filter(~wide).withColumn("_block", block_of(low))).select(*ranges.columns, "text")
    parts = meet(ranges.filter(wide).withColumn("_block", F.explode(F.sequence(block_of(low), block_of(high)))))
    others = [c for c in ranges.columns if c not in key]
    whole = parts.groupBy(*key).agg(*[F.first(c).alias(c) for c in others], F.sort_array(F.collect_list(F.struct("_block", "text"))).alias("_p"))
    return one.unionByName(whole.select(*ranges.columns, F.array_join("_p.text", "").alias("text")))


def range_text(ranges: DataFrame, pages: DataFrame | Pages, key: list[str], labels: bool = False, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """(key, text) of ranges; see with_range_text."""
    columns = list(dict.fromkeys([*key, "doc_id", first, last]))
    return with_range_text(ranges.select(*columns), pages, key, labels, first, last).select(*key, "text")


def pages_needed(ranges: DataFrame, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """The distinct (doc_id, page) of all ranges."""
    return ranges_to_pages(ranges.select("doc_id", first, last), first, last).select("doc_id", "page").distinct()


def validate_physical_index(items: DataFrame, stats: DataFrame, start_index: int = 1) -> DataFrame:
    """An index beyond the last page becomes null."""
    beyond = F.col("physical_index") > F.col("n_pages") + (start_index - 1)
    return items.join(stats.select("doc_id", "n_pages"), "doc_id").withColumn("physical_index", F.when(beyond, None).otherwise(F.col("physical_index"))).select(*items.columns)


def apply_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """U4: page plus the document's offset as physical_index, page cleared; without either the item stays as it is.

    A sum beyond LARGEST is LARGEST, which lies beyond every document, so `validate_physical_index` drops it.
    """
    joined = items.join(offsets, "doc_id", "left")
    moved = F.col("page").isNotNull() & F.col("offset").isNotNull()
    return joined.withColumns({"physical_index": F.when(moved, _bounded(F.col("page").cast("long") + F.col("offset"))).otherwise(F.col("physical_index")), "page": F.when(moved, None).otherwise(F.col("page"))}).select(*items.columns)


def append_items(first: DataFrame, then: DataFrame) -> DataFrame:
    """The items of then after those of first in each document, numbered anew."""
    both = first.withColumn("_part", F.lit(0)).unionByName(then.withColumn("_part", F.lit(1)))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("_part", "pos")) - 1
    return both.withColumn("pos", pos).drop("_part")


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, norm) of lines that are not blank; line_no 0 is the first of them."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    out = pages.select("doc_id", "page", F.posexplode(lines).alias("line_no", "_l"))
    return out.select("doc_id", "page", "line_no", rules.squashed_line("_l").alias("norm"))


def _wanted_lines(wanted: DataFrame, pages: DataFrame, n: int) -> DataFrame:
    """(doc_id, page, norm, _first): lines that may equal a norm of wanted, of which there are n.

    A broadcast bitmap of (doc_id, norm) drops the others where they are read, before anything is shuffled.
    """
    lines = page_lines(pages).filter("norm <> ''").withColumn("_first", F.col("line_no") == 0).drop("line_no")
    return likely_members(lines, wanted, ["doc_id", "norm"], n)


def _places(wanted: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, page, at_top) of wanted (key, doc_id, norm, and perhaps first_page and last_page): pages with a line equal to norm.

    wanted is written once; the bitmap, its size and the join all read that. Lines that pass the bitmap meet the
    wanted ones before anything is aggregated.
    """
    wanted = cut(wanted)
    hits = _wanted_lines(wanted, pages, wanted.count()).join(wanted, ["doc_id", "norm"])
    if "first_page" in wanted.columns:
        hits = hits.filter("page between first_page and last_page")
    return hits.groupBy(*key, "page").agg(F.bool_or("_first").alias("at_top"))


def title_places(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pos, page, at_top): pages with a line that equals the item's title, white space, case and leading code aside.

    An equi-join of titles and lines that could be titles; each page counts once.
    """
    wanted = items.select("doc_id", "pos", rules.squash("title").alias("norm")).filter("norm <> ''")
    return _places(wanted, pages, ["doc_id", "pos"])


def locate(items: DataFrame, pages: DataFrame, bounds: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, physical_index, confidence) for every item.

    The one page that has the title at its top, high; else the first page that has it, low; else null, low.
    bounds (doc_id, pos, first_page, last_page) limits the pages, and items that it lacks are found nowhere;
    pages of without (doc_id, page) do not count.
    """
    wanted = items.select("doc_id", "pos", rules.squash("title").alias("norm")).filter("norm <> ''")
    if bounds is not None:
        wanted = wanted.join(bounds.select("doc_id", "pos", "first_page", "last_page"), ["doc_id", "pos"])
    places = _places(wanted, pages, ["doc_id", "pos"])
    if without is not None:
        places = places.join(without.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    best = places.groupBy("doc_id", "pos").agg(F.min("page").alias("first"), F.min(F.when(F.col("at_top"), F.col("page"))).alias("top"), F.count_if("at_top").alias("tops"))
    sure = F.col("tops") == 1
    found = best.select("doc_id", "pos", F.when(sure, F.col("top")).otherwise(F.col("first")).alias("physical_index"), F.when(sure, "high").otherwise("low").alias("confidence"))
    return items.select("doc_id", "pos").join(found, ["doc_id", "pos"], "left").select("doc_id", "pos", "physical_index", F.coalesce("confidence", F.lit("low")).alias("confidence"))


def ask_places(items: DataFrame, places: DataFrame, pages: DataFrame, bounds: DataFrame, answers: Answers) -> DataFrame:
    """places of `locate` with what a model answered from the tagged pages of each item's bounds."""
    text = range_text(bounds, pages, ["doc_id", "pos"], labels=True, first="first_page", last="last_page")
    asked = items.select("doc_id", "pos", "title").join(text, ["doc_id", "pos"]).join(places, ["doc_id", "pos"])
    # A response about an index has a confidence, so both or neither are its own.
    none = asked.withColumns({"_index": F.lit(None).cast("int"), "_sure": F.lit(None).cast("string")})
    told = answers.apply("locate", none, ["pos"], _index="physical_index", _sure="confidence").filter("_index is not null").select("doc_id", "pos", "_index", "_sure")
    joined = places.join(told, ["doc_id", "pos"], "left")
    return joined.select("doc_id", "pos", F.coalesce("_index", "physical_index").alias("physical_index"), F.coalesce("_sure", "confidence").alias("confidence"))


def _numbered(batches):
    """pos and structure of heading lines in reading order: each markdown level counts its headings since the last higher one."""
    doc, pos, counts = object(), 0, [0] * 7
    for ids, _, _, codes, levels in batches:
        places, out = [], []
        for i, code, level in zip(ids, codes, levels):
            if i != doc:
                doc, pos, counts = i, 0, [0] * 7
            if level is not None:
                counts[level] += 1
                counts[level + 1 :] = [0] * (6 - level)
                code = ".".join(str(n) for n in counts[1 : level + 1] if n)
            places.append(pos)
            out.append(code)
            pos += 1
        yield places, out


_numbered.reads = ["doc_id", "page", "line_no", "_code", "level"]


def extract_headings(pages: DataFrame) -> DataFrame:
    """Items from heading lines, (doc_id, pos, structure, title, physical_index) in reading order; contents pages do not count.

    Text is read once and does not move; heading lines are sorted and numbered.
    """
    lines = pages.filter(~rules.is_toc_page("text")).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "_l")).filter(rules.may_be_heading(F.col("_l")))
    # An array of none or one keeps the rule from being worked out again for each of its fields.
    found = lines.select("doc_id", "page", "line_no", F.explode(F.filter(F.array(rules.heading(F.col("_l"))), lambda h: h.isNotNull())).alias("_h"))
    rows = found.select("doc_id", "page", "line_no", F.col("_h.structure").alias("_code"), "_h.title", "_h.level")
    made = folded(rows, ["page", "line_no"], _numbered, [("pos", "int"), ("structure", "string")])
    return made.select("doc_id", "pos", "structure", "title", F.col("page").alias("physical_index"))


def group_headings(pages: DataFrame, answers: Answers, max_tokens: int = 20_000) -> DataFrame:
    """Items as of `extract_headings`, by groups of pages: a model's list where there is one, else the rule's of the group's new pages."""
    groups = group_pages(pages, max_tokens)
    # Questions are read three times, and text is put together once.
    asked = cut(group_text(groups, pages)).withColumn("_items", F.lit(None).cast("array<struct<structure:string,title:string,page:int,physical_index:int>>"))
    told = answers.apply("headings", asked, ["group_no"], _items="items").filter("_items is not null").select("doc_id", "group_no", "_items")
    own = groups.groupBy("doc_id", F.col("page").alias("physical_index")).agg(F.min("group_no").alias("group_no"))
    ruled = extract_headings(pages).join(own, ["doc_id", "physical_index"]).join(told.select("doc_id", "group_no"), ["doc_id", "group_no"], "left_anti")
    given = told.select("doc_id", "group_no", F.posexplode("_items").alias("pos", "_x")).select("doc_id", "group_no", "pos", "_x.structure", "_x.title", "_x.physical_index")
    both = ruled.select("doc_id", "group_no", "pos", "structure", "title", "physical_index").unionByName(given.filter("physical_index is not null"))
    pos = (F.row_number().over(Window.partitionBy("doc_id").orderBy("group_no", "pos")) - 1).cast("int")
    return both.withColumn("pos", pos).select("doc_id", "pos", "structure", "title", "physical_index")
