"""Checks of items against page text, repair, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules
from ..sources.scratch import cut
from . import mapping
from .pages import Pages
from .requests import Answers


def check_titles(items: DataFrame, pages: DataFrame | Pages, answers: Answers | None = None) -> DataFrame:
    """(doc_id, pos, title, physical_index, appears, at_start) of items with an index, against that page.

    An index without a page is not found. Stored pages stay where they are: items go to them.
    """
    named = items.filter("physical_index is not null").select("doc_id", "pos", "title", "physical_index")
    seen = Pages.of(pages).text_of(named, "physical_index")
    if answers is not None:
        seen = cut(seen)  # it is read three times
    seen = seen.withColumn("_r", rules.title_appears("title", "text"))
    seen = seen.select("doc_id", "pos", "title", "physical_index", "text", F.col("_r.appears").alias("appears"), F.col("_r.at_start").alias("at_start"))
    if answers is not None:
        seen = answers.apply("appears", seen, ["pos", "physical_index"], appears="answer", at_start="at_start")
    return seen.drop("text")


def accuracy(items: DataFrame, checks: DataFrame, stats: DataFrame) -> DataFrame:
    """A4: (doc_id, accuracy, incorrect) of each document: the share of checks that passed, and the number that did not.

    0 and none if nothing was checked, or if the last index in list order is below half the number of pages.
    """
    last = items.filter("physical_index is not null").groupBy("doc_id").agg(F.max_by("physical_index", "pos").alias("last"))
    rates = checks.groupBy("doc_id").agg(F.avg(F.col("appears").cast("double")).alias("rate"), F.count_if(~F.col("appears")).alias("wrong"))
    joined = stats.select("doc_id", "n_pages").join(last, "doc_id", "left").join(rates, "doc_id", "left")
    checked = F.col("last").isNotNull() & (F.col("last") >= F.col("n_pages") / 2)
    return joined.select("doc_id", F.when(checked, F.coalesce("rate", F.lit(0.0))).otherwise(0.0).alias("accuracy"), F.when(checked, F.coalesce("wrong", F.lit(0))).otherwise(0).cast("long").alias("incorrect"))


def verify(items: DataFrame, pages: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (checks, accuracy) of all items."""
    checks = check_titles(items, pages)
    return checks, accuracy(items, checks, stats)


def sample_items(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N items a document, those of the least MD5 of `doc_id:pos:seed`: the same ones at each call and in any engine."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", "doc_id", "pos", F.lit(seed))), "pos"))
    return items.withColumn("_turn", turn).filter(F.col("_turn") <= n).drop("_turn")


def fill_appear_start(items: DataFrame, pages: DataFrame | Pages, answers: Answers | None = None) -> DataFrame:
    """appear_start where it is null: whether the item's page begins with its title; false without an index."""
    missing = items.filter("appear_start is null")
    starts = check_titles(missing, pages, answers).select("doc_id", "pos", "at_start")
    return items.join(starts, ["doc_id", "pos"], "left").withColumn("appear_start", F.coalesce("appear_start", "at_start", F.lit(False))).select(*items.columns)


def cache_appear_start(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Items with the appear_start of checks that passed."""
    passed = checks.filter("appears").select("doc_id", "pos", "at_start")
    return items.join(passed, ["doc_id", "pos"], "left").withColumn("appear_start", F.coalesce("at_start", "appear_start")).select(*items.columns)


def repair_once(items: DataFrame, wrong: DataFrame, pages: DataFrame | Pages, stats: DataFrame, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """One round of C4: (items with what could be repaired, wrong items that remain).

    Each wrong item (doc_id, pos) is looked for between the nearest items before and after that are not wrong.
    A sure place is taken; any other place only if the title appears there.
    """
    keys = wrong.select("doc_id", "pos", F.lit(True).alias("_wrong"))
    marked = items.join(keys, ["doc_id", "pos"], "left").join(stats.select("doc_id", "n_pages"), "doc_id")
    bounds = mapping.neighbour_bounds(marked, F.col("_wrong").isNull() & F.col("physical_index").isNotNull(), F.lit(0), F.col("n_pages")).filter("_wrong")
    window = bounds.select("doc_id", "pos", F.greatest("prev_index", F.lit(1)).alias("first_page"), F.least("next_index", "n_pages").alias("last_page"))
    places = mapping.locate(bounds.select("doc_id", "pos", "title"), Pages.of(pages).flat, window)
    if answers is not None:
        places = mapping.ask_places(bounds.select("doc_id", "pos", "title"), places, pages, window, answers)
    again = check_titles(bounds.select("doc_id", "pos", "title").join(places, ["doc_id", "pos"]), pages, answers).select("doc_id", "pos", "appears")
    judged = places.join(again, ["doc_id", "pos"], "left")
    fine = F.col("physical_index").isNotNull() & ((F.col("confidence") == "high") | F.coalesce("appears", F.lit(False)))
    judged = cut(judged.select("doc_id", "pos", F.when(fine, F.col("physical_index")).alias("_new")))
    fixed = items.join(judged, ["doc_id", "pos"], "left").withColumn("physical_index", F.coalesce("_new", "physical_index")).select(*items.columns)
    return fixed, judged.filter("_new is null").select("doc_id", "pos")


def repair(items: DataFrame, checks: DataFrame, pages: DataFrame | Pages, stats: DataFrame, max_rounds: int = 2, answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """C4: repairs items whose check failed, in at most max_rounds rounds; also what remains wrong."""
    wrong = cut(checks.filter(~F.col("appears")).select("doc_id", "pos"))
    for _ in range(max_rounds):
        if wrong.isEmpty():
            break
        items, wrong = repair_once(items, wrong, pages, stats, answers)
        items = cut(items)
    return items, wrong


def repair_report(before: DataFrame, after: DataFrame, remaining: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, fixed, invalid, truncated): items whose index changed, that remain wrong, and that lay beyond the last page."""
    joined = before.select("doc_id", "pos", F.col("physical_index").alias("_b")).join(after.select("doc_id", "pos", F.col("physical_index").alias("_a")), ["doc_id", "pos"], "left")
    joined = joined.join(remaining.select("doc_id", "pos", F.lit(True).alias("_r")), ["doc_id", "pos"], "left").join(stats.select("doc_id", "n_pages"), "doc_id")
    return joined.groupBy("doc_id").agg(
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b")) & F.col("_a").isNotNull()).alias("fixed"), F.count_if(F.coalesce("_r", F.lit(False))).alias("invalid"), F.count_if(F.col("_b") > F.col("n_pages")).alias("truncated")
    )


def batch_pages(pages: DataFrame, k: int) -> DataFrame:
    """(doc_id, batch, page): k consecutive pages a batch, one at least."""
    batch = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1) / max(1, k)).cast("int")
    return pages.select("doc_id", batch.alias("batch"), "page")
