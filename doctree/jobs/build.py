"""Jobs that build trees: paths A, B and C to a table of contents, their cascade, and the index of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import detect, enrich, mapping, split, tree, verify
from ..operators.pages import Pages, stored_pages
from ..operators.requests import Answers
from ..sources.scratch import cut, keep, scope

_ITEMS = ("doc_id", "pos", "structure", "title", "page", "physical_index", "appear_start")


@dataclass(frozen=True)
class Knobs:
    toc_check_page_num: int = 20
    toc_index_max_tokens: int | None = 6000
    toc_resolve_max_tokens: int | None = 6000
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 20_000
    accept_and_fix: float = 0.6
    repair_rounds: int = 2
    split_rounds: int | None = None
    split_internal: bool = False
    summaries: bool = True
    node_text: bool = False


def _items(df: DataFrame) -> DataFrame:
    kinds = {"page": "int", "physical_index": "int", "appear_start": "boolean"}
    for c, kind in kinds.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.select(*_ITEMS)


def _toc_pages(detected: DataFrame) -> DataFrame:
    return detected.select("doc_id", F.explode("toc_pages").alias("page"))


def toc_with_pages(detected: DataFrame, pages: DataFrame | Pages, knobs: Knobs = Knobs(), answers: Answers | None = None) -> DataFrame:
    """C1, path A: printed entries, shifted by the offset that sampled titles show; what is left is looked for between its neighbours."""
    paged, pages = pages, Pages.of(pages).flat
    entries = cut(_items(detect.toc_entries(detected, answers)))
    near = mapping.prefix_within_budget(pages, detected, knobs.toc_check_page_num, knobs.toc_index_max_tokens)
    sample = mapping.evenly_spaced(entries.select("doc_id", "pos", "title"), 8)
    found = mapping.locate(sample, pages.join(near, ["doc_id", "page"], "left_semi")).join(sample, ["doc_id", "pos"])
    offsets = mapping.page_offset(mapping.match_title_pairs(entries, found, detected))
    items = cut(mapping.apply_offset(entries, offsets))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    bounds = mapping.neighbour_bounds(items.join(last, "doc_id"), F.col("physical_index").isNotNull(), F.lit(0), F.col("_last")).filter("physical_index is null")
    window = mapping.resolve_window(bounds.select("doc_id", "pos", "prev_index", "next_index"), pages, knobs.toc_resolve_max_tokens)
    places = mapping.locate(bounds.select("doc_id", "pos", "title"), pages, window, _toc_pages(detected))
    if answers is not None:
        places = mapping.ask_places(bounds, places, paged, window, answers)
    places = places.select("doc_id", "pos", F.col("physical_index").alias("_found"))
    joined = items.join(places, ["doc_id", "pos"], "left")
    return joined.withColumns({"page": F.when(F.col("_found").isNull(), F.col("page")), "physical_index": F.coalesce("physical_index", "_found")}).select(*_ITEMS)


def toc_without_pages(detected: DataFrame, pages: DataFrame, answers: Answers | None = None) -> DataFrame:
    """C2, path B: printed titles at the first page outside the contents that has them as a line."""
    entries = detect.toc_entries(detected, answers)
    body = pages.join(_toc_pages(detected), ["doc_id", "page"], "left_anti")
    first = mapping.title_places(entries, body).groupBy("doc_id", "pos").agg(F.min("page").alias("physical_index"))
    return _items(entries.join(first, ["doc_id", "pos"], "left"))


def no_toc(pages: DataFrame, answers: Answers | None = None, max_tokens: int = 20_000) -> DataFrame:
    """C3, path C: headings of the pages; a model's lists are asked for by groups of pages."""
    return _items(mapping.extract_headings(pages) if answers is None else mapping.group_headings(pages, answers, max_tokens))


def resolve_toc(detected: DataFrame, pages: DataFrame | Pages, stats: DataFrame, knobs: Knobs = Knobs(), answers: Answers | None = None) -> DataFrame:
    """Items of each document with path (A, B or C) and outcome (accepted, repaired or best effort).

    Documents with printed page numbers start on path A, all others on C. All checks right: accepted. More
    than accept_and_fix of them right: repaired. Else the next path, and after C what there is. Only the
    documents that fall through are read again.
    """
    pages = Pages.of(pages)
    detected = cut(detected.withColumn("_mode", F.when((F.trim(F.coalesce("toc_content", F.lit(""))) != "") & F.col("has_page_numbers"), "A").otherwise("C")))
    waiting, out = detected.filter("_mode = 'A'").select("doc_id"), None
    for path in "ABC":
        if path == "C":
            waiting = waiting.unionByName(detected.filter("_mode = 'C'").select("doc_id"))
        docs = cut(waiting)
        if not (n := docs.count()):
            continue
        own, some = pages.only(docs, n), detected.join(docs, "doc_id", "left_semi")
        items = toc_with_pages(some, own, knobs, answers) if path == "A" else toc_without_pages(some, own.flat, answers) if path == "B" else no_toc(own.flat, answers, knobs.max_tokens_per_node)
        # Of other documents there may be pages, but must be no items.
        items = items.join(docs, "doc_id", "left_semi")
        items = mapping.validate_physical_index(items.filter("physical_index is not null"), stats)
        # List order stays, numbered without gaps.
        items = cut(items.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1))
        known = stats.join(docs, "doc_id", "left_semi")
        checks = cut(verify.check_titles(items, own, answers))
        rates = cut(verify.accuracy(items, checks, known))
        items = verify.cache_appear_start(items, checks)
        outcome = F.when((F.col("accuracy") == 1) & (F.col("incorrect") == 0), "accepted").when((F.col("accuracy") > knobs.accept_and_fix) & (F.col("incorrect") > 0), "repaired").otherwise("best effort" if path == "C" else "next")
        rates = cut(rates.select("doc_id", outcome.alias("outcome")))
        fine = items.join(rates.filter("outcome in ('accepted', 'best effort')"), "doc_id")
        broken = rates.filter("outcome = 'repaired'")
        fixed, _ = verify.repair(items.join(broken, "doc_id", "left_semi"), checks.join(broken, "doc_id", "left_semi"), own, known, knobs.repair_rounds, answers)
        done = cut(fine.unionByName(fixed.join(broken, "doc_id")).withColumn("path", F.lit(path)))
        out = done if out is None else out.unionByName(done)
        waiting = rates.filter("outcome = 'next'").select("doc_id")
    if out is None:
        empty = _items(mapping.extract_headings(pages.flat.limit(0)))
        return empty.withColumns({"outcome": F.lit(""), "path": F.lit("")})
    return out


def build_nodes(pages: DataFrame | Pages, knobs: Knobs = Knobs(), answers: Answers | None = None) -> DataFrame:
    """The nodes of C7 before text and summaries: (doc_id, path, title, start_index, end_index, ids and flags)."""
    stats = cut(detect.doc_stats(Pages.of(pages).flat))
    items = resolve_toc(detect.detect_toc(pages, knobs.toc_check_page_num, answers), pages, stats, knobs, answers).select(*_ITEMS)
    items = tree.add_preface(items.filter("physical_index is not null"))
    items = cut(verify.fill_appear_start(items, pages, answers))
    ranged = tree.assign_ranges(items, stats.select("doc_id", F.col("n_pages").alias("end_page")))
    made = cut(tree.build_tree(ranged))
    parents = made.select("doc_id", F.col("parent_pos").alias("pos"), F.lit(False).alias("_leaf")).filter("pos is not null").distinct()
    nodes = made.join(parents, ["doc_id", "pos"], "left").withColumn("is_leaf", F.coalesce("_leaf", F.lit(True)))
    parts = split.split_large(nodes, pages, knobs.max_pages_per_node, knobs.max_tokens_per_node, knobs.split_rounds, knobs.split_internal, answers, knobs.accept_and_fix, knobs.repair_rounds)
    return tree.write_node_ids(parts.withColumn("depth", F.size("path") - 1))


def build_index(pages: DataFrame, names: DataFrame | None = None, knobs: Knobs = Knobs(), answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """(index_docs, nodes) of a corpus of pages.

    names has (doc_id, doc_name); without it a document is called by its id. Documents without headings have
    an empty tree. Nodes have summaries and, with node_text, the text of leaves. With answers every judgement
    that a model has answered replaces its rule, and `answers.open` lists the requests that are left. Both results
    are written tables; all others that the job has written are gone when it returns. Page text is stored in blocks first and
    is not shuffled again.
    """
    with scope(pages.sparkSession), stored_pages(pages) as pages:
        nodes = cut(build_nodes(pages, knobs, answers))
        if knobs.summaries or knobs.node_text:
            nodes = enrich.add_node_text(nodes, pages)
            if knobs.summaries:
                # Texts are written only where they are read more than once.
                nodes = cut(nodes) if knobs.node_text or answers is not None else nodes
                nodes = enrich.summarize(nodes, answers=answers, keep_text=knobs.node_text)
        nodes = keep(nodes)
        docs = pages.flat.select("doc_id").distinct()
        docs = docs.join(names.select("doc_id", "doc_name"), "doc_id", "left") if names is not None else docs.withColumn("doc_name", F.col("doc_id"))
        docs = docs.join(tree.export_tree(nodes), "doc_id", "left")
        if knobs.summaries:
            docs = docs.join(enrich.describe_documents(nodes, answers=answers), "doc_id", "left")
        else:
            docs = docs.withColumn("doc_description", F.lit(None).cast("string"))
        columns = [F.coalesce("doc_name", "doc_id").alias("doc_name"), "doc_description", F.coalesce("structure_json", F.lit("[]")).alias("structure_json")]
        return keep(docs.select("doc_id", *columns)), nodes
