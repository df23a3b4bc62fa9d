"""Tables of contents: which pages hold them, their text, and whether it has page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules
from ..functions.scalars import normalize_leaders
from .pages import Pages
from .requests import Answers


def doc_stats(pages: DataFrame) -> DataFrame:
    """A1: (doc_id, n_pages, n_tokens)."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"), F.sum("token_length").cast("long").alias("n_tokens"))


def toc_flags(pages: DataFrame, toc_check_page_num: int = 20, answers: Answers | None = None) -> DataFrame:
    """(doc_id, page, is_toc) of the first pages of each document."""
    flags = pages.filter(F.col("page") <= toc_check_page_num).select("doc_id", "page", "text", rules.is_toc_page("text").alias("is_toc"))
    if answers is not None:
        flags = answers.apply("toc_page", flags, ["page"], is_toc="answer")
    return flags.select("doc_id", "page", "is_toc")


def toc_runs(flags: DataFrame) -> DataFrame:
    """(doc_id, run, page) of flagged pages; a run is contiguous and is named by its first page."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    marked = flags.filter("is_toc").select("doc_id", "page", island.alias("_island"))
    return marked.select("doc_id", F.min("page").over(Window.partitionBy("doc_id", "_island")).alias("run"), "page")


def find_toc_pages(flags: DataFrame, start: int = 1, toc_check_page_num: int = 20) -> DataFrame:
    """(doc_id, toc_pages) of the first run from page start on within the window; documents without one are left out."""
    runs = toc_runs(flags.filter(F.col("page").between(start, toc_check_page_num)))
    first = F.min("run").over(Window.partitionBy("doc_id"))
    return runs.withColumn("_first", first).filter("run = _first").groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("toc_pages"))


def toc_content(toc_pages: DataFrame, pages: DataFrame | Pages) -> DataFrame:
    """A2: (doc_id, run, toc_pages, toc_content): text of each run's pages in order, leaders normalised."""
    texts = Pages.of(pages).text_of(toc_pages, "page")
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    out = texts.groupBy("doc_id", "run").agg(parts.alias("_parts"))
    return out.select("doc_id", "run", F.col("_parts.page").alias("toc_pages"), normalize_leaders(F.array_join("_parts.text", "")).alias("toc_content"))


def detect_toc(pages: DataFrame | Pages, toc_check_page_num: int = 20, answers: Answers | None = None) -> DataFrame:
    """(doc_id, toc_content, toc_pages, has_page_numbers), a row a document.

    The first run of contents pages that has page numbers wins; if none has, the first run. Documents without
    one have null content, no pages and false. Only flagged pages are joined back to their text.
    """
    flat = Pages.of(pages).flat
    runs = toc_runs(toc_flags(flat, toc_check_page_num, answers))
    text = toc_content(runs, pages).withColumn("has_page_numbers", rules.has_page_numbers("toc_content"))
    if answers is not None:
        text = answers.apply("page_numbers", text, ["run"], has_page_numbers="answer")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("has_page_numbers").desc(), "run"))
    best = text.withColumn("_turn", turn).filter("_turn = 1")
    docs = flat.select("doc_id").distinct()
    return docs.join(best, "doc_id", "left").select(
        "doc_id", "toc_content", F.coalesce("toc_pages", F.array().cast("array<int>")).alias("toc_pages"), F.coalesce("has_page_numbers", F.lit(False)).alias("has_page_numbers")
    )


def toc_entries(detected: DataFrame, answers: Answers | None = None) -> DataFrame:
    """Printed entries (doc_id, pos, structure, title, page), pos from 0."""
    found = detected.filter("toc_content is not null").select("doc_id", "toc_content", rules.parse_toc_lines("toc_content").alias("_entries"))
    if answers is not None:
        listed = answers.apply("entries", found.withColumn("_items", F.lit(None).cast("array<struct<structure:string,title:string,page:int,physical_index:int>>")), _items="items")
        given = F.transform("_items", lambda x: F.struct(x["structure"].alias("structure"), x["title"].alias("title"), x["page"].alias("page")))
        found = listed.withColumn("_entries", F.coalesce(given, "_entries"))
    return found.select("doc_id", F.posexplode("_entries").alias("pos", "_e")).select("doc_id", "pos", "_e.structure", "_e.title", "_e.page")
