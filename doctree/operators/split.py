"""Large leaves split by the headings inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import cut
from . import mapping, tree, verify
from .pages import Pages
from .requests import Answers, PartAnswers


def large_nodes(nodes: DataFrame, pages: DataFrame | Pages, max_pages: int = 10, max_tokens: int = 20_000) -> DataFrame:
    """Nodes whose end lies more than max_pages after their start and whose pages hold max_tokens tokens or more.

    Running sums of token counts are looked up at both ends, so no page text moves and no range is exploded.
    """
    total = F.sum("token_length").over(Window.partitionBy("doc_id").orderBy("page"))
    sums = Pages.of(pages).flat.select("doc_id", "page", total.alias("total"))
    long = nodes.filter(F.col("end_index") - F.col("start_index") > max_pages)
    high = sums.select("doc_id", F.col("page").alias("end_index"), F.col("total").alias("_high"))
    low = sums.select("doc_id", (F.col("page") + 1).alias("start_index"), F.col("total").alias("_low"))
    both = long.join(high, ["doc_id", "end_index"]).join(low, ["doc_id", "start_index"], "left")
    return both.filter(F.col("_high") - F.coalesce("_low", F.lit(0)) >= max_tokens).select(*nodes.columns)


_COLUMNS = ("doc_id", "path", "title", "start_index", "end_index", "is_leaf")
#: Of the leaf that a node was split off: its length in pages and its number of headings; null for nodes that were given.
_PROGRESS = ("up_pages", "up_items")


def _answered_headings(own: DataFrame, answers: PartAnswers, max_tokens: int, accept_and_fix: float, rounds: int) -> DataFrame:
    """Headings of parts (pages of which are own) as a model gives them, or the rule; then checked and repaired as those of whole documents are.

    The early exit of `accuracy` compares the last index, a page of the document, with the number of pages of the part.
    """
    stats = cut(own.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"), F.max("page").alias("last")))
    ends = stats.select("doc_id", F.col("last").alias("n_pages"))
    found = mapping.group_headings(own, answers, max_tokens).withColumns({"page": F.lit(None).cast("int"), "appear_start": F.lit(None).cast("boolean")})
    found = mapping.validate_physical_index(found, ends).filter("physical_index is not null")
    items = cut(found.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1))
    checks = cut(verify.check_titles(items, own, answers))
    rates = verify.accuracy(items, checks, stats)
    items = verify.cache_appear_start(items, checks)
    broken = cut(rates.filter((F.col("accuracy") > accept_and_fix) & (F.col("incorrect") > 0)).select("doc_id"))
    fixed, _ = verify.repair(items.join(broken, "doc_id", "left_semi"), checks.join(broken, "doc_id", "left_semi"), own, ends, rounds, answers)
    return items.join(broken, "doc_id", "left_anti").unionByName(fixed).drop("page")


def _round(front: DataFrame, pages: DataFrame | Pages, max_pages: int, max_tokens: int, answers: Answers | None, accept_and_fix: float, repair_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(front with shrunk ends and leaf flags, the nodes below the leaves that were split).

    A leaf must be shorter than the one it comes from, or have fewer headings; so splitting comes to an end.
    """
    key = F.concat_ws("#", "doc_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
    large = cut(large_nodes(front.filter("is_leaf"), pages, max_pages, max_tokens).withColumn("_key", key))
    if large.isEmpty():
        return front, front.limit(0)
    # Each large leaf is taken as a document of its own.
    ranges = large.select("_key", "doc_id", "start_index", "end_index")
    own = mapping.pages_in_range(ranges, pages).select(F.col("_key").alias("doc_id"), "page", "text", "token_length")
    if answers is None:
        items = mapping.extract_headings(own).withColumn("appear_start", F.lit(None).cast("boolean"))
        items = cut(verify.fill_appear_start(items, own))
    else:
        own, asked = cut(own), PartAnswers(answers, lambda part: F.regexp_extract(part, r"(?s)^(.*)#[0-9.]*$", 1))
        items = cut(verify.fill_appear_start(_answered_headings(own, asked, max_tokens, accept_and_fix, repair_rounds), own, asked))
    heads = large.select(F.col("_key").alias("doc_id"), F.trim("title").alias("_title"), F.col("path").alias("_path"), F.col("doc_id").alias("_doc"), F.col("end_index").alias("end_page"))
    first = items.join(heads.select("doc_id", "_title"), "doc_id").filter((F.col("pos") == 0) & (F.trim("title") == F.col("_title"))).select("doc_id", "pos")
    kept = items.join(first, ["doc_id", "pos"], "left_anti")
    counts = kept.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").cast("int").alias("_items"))
    less = F.col("up_pages").isNull() | (F.col("end_index") - F.col("start_index") < F.col("up_pages")) | (F.col("_items") < F.col("up_items"))
    counts = cut(large.join(counts, "_key").filter(less).select("_key", F.col("_items").alias("up_items"), (F.col("end_index") - F.col("start_index")).alias("up_pages")))
    kept = cut(kept.join(counts.select(F.col("_key").alias("doc_id")), "doc_id", "left_semi"))
    made = tree.build_tree(tree.assign_ranges(kept, heads))
    below = made.join(heads.select("doc_id", "_path", "_doc"), "doc_id")
    has_child = below.select("doc_id", F.col("parent_pos").alias("pos"), F.lit(False).alias("_leaf")).filter("pos is not null").distinct()
    below = below.join(has_child, ["doc_id", "pos"], "left").join(counts, below["doc_id"] == counts["_key"])
    below = below.select(F.col("_doc").alias("doc_id"), F.concat("_path", "path").alias("path"), "title", "start_index", "end_index", F.coalesce("_leaf", F.lit(True)).alias("is_leaf"), *_PROGRESS)
    starts = kept.groupBy(F.col("doc_id").alias("_key")).agg(F.min_by("physical_index", "pos").alias("_end"))
    shrunk = large.select("_key", "doc_id", "path").join(starts, "_key").select("doc_id", "path", "_end")
    after = front.join(shrunk, ["doc_id", "path"], "left").withColumns({"end_index": F.coalesce("_end", "end_index"), "is_leaf": F.col("is_leaf") & F.col("_end").isNull()}).drop("_end")
    return after.select(*_COLUMNS), below.select(*_COLUMNS, *_PROGRESS)


def split_large(
    nodes: DataFrame,
    pages: DataFrame | Pages,
    max_pages: int = 10,
    max_tokens: int = 20_000,
    max_rounds: int | None = None,
    split_internal: bool = False,
    answers: Answers | None = None,
    accept_and_fix: float = 0.6,
    repair_rounds: int = 2,
) -> DataFrame:
    """K7: nodes (doc_id, path, title, start_index, end_index, is_leaf) with large leaves split until none is left that can be.

    The headings inside a large leaf become nodes below it, without the first if it repeats the leaf's title. The
    leaf's end moves to the start of the first of them; a leaf without any stays as it is, and so does one that
    would be split into itself again. Each round takes all large leaves of the corpus at once, the new ones in
    the next; max_rounds, if given, ends that early. Headings of the rule stand on the page they are found on, so they
    need no further check. With answers the headings of each large leaf, their places and their starts are asked for,
    under the leaf's document and with its path in the keys, and what a model gives is checked and repaired; what is
    not answered yet splits by the rule, and the next run with more responses splits anew. With split_internal large nodes with children are split too: the nodes below them give way.
    """
    front = nodes.select(*_COLUMNS)
    if split_internal:
        front = cut(front)
        large = large_nodes(front.filter("not is_leaf"), pages, max_pages, max_tokens).select("doc_id", F.col("path").alias("_up"))
        # Each node looks itself and the nodes above it up; the highest large one wins.
        own = front.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))))
        under = own.join(large, ["doc_id", "_up"]).groupBy("doc_id", "path").agg(F.min(F.size("_up")).alias("_top"))
        front = front.join(under, ["doc_id", "path"], "left").filter("_top is null or _top = size(path)").withColumn("is_leaf", F.col("is_leaf") | F.col("_top").isNotNull()).drop("_top")
    done, front, rounds = None, cut(front.withColumns({c: F.lit(None).cast("int") for c in _PROGRESS})), 0
    while max_rounds is None or rounds < max_rounds:
        after, below = _round(front, pages, max_pages, max_tokens, answers, accept_and_fix, repair_rounds)
        front, after = cut(below), cut(after.select(*_COLUMNS))
        done = after if done is None else done.unionByName(after)
        rounds += 1
        if front.isEmpty():
            return done
    front = front.select(*_COLUMNS)
    return front if done is None else done.unionByName(front)
