"""A query for each operator over the given tables, most of them on the book view of `documents`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import rules, scalars
from .jobs import batch, build, lookup
from .operators import catalog as lookups
from .operators import detect, enrich, mapping, split, tree, verify
from .operators import requests as ask
from .sources import books, files, store
from .sources.scratch import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Limits that the test documents reach.
MAX_PAGES, MAX_TOKENS, GROUP_TOKENS = 3, 300, 400


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(books.books(_documents(spark, sf_dir)))


def _numbered(items: DataFrame) -> DataFrame:
    return items.withColumns({"page": F.lit(None).cast("int"), "appear_start": F.lit(None).cast("boolean")})


def _headings(pages: DataFrame) -> DataFrame:
    return _numbered(cut(mapping.extract_headings(pages)))


def _printed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    detected = cut(detect.detect_toc(pages))
    return detected, cut(detect.toc_entries(detected))


def _ranged(pages: DataFrame) -> DataFrame:
    items = verify.fill_appear_start(tree.add_preface(_headings(pages)), pages)
    ends = detect.doc_stats(pages).select("doc_id", F.col("n_pages").alias("end_page"))
    return cut(tree.assign_ranges(items, ends))


def _nodes(pages: DataFrame) -> DataFrame:
    return cut(tree.write_node_ids(tree.build_tree(_ranged(pages))))


def _summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return enrich.summarize(enrich.add_node_text(_nodes(pages), pages), keep_text=False)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    name = F.concat(F.lit("Doc-"), "doc_id", F.lit(".pdf"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("pdf").alias("type"), name.alias("doc_name"), F.col("source").alias("doc_description"), F.concat_ws("/", "source", name).alias("path"), F.lit(1).alias("page_count"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question a turn: by turn modulo 3 with an exact name, a stem in capitals, or a name that nothing has."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by = F.col("turn") % 3
    name = F.when(by == 0, F.concat(F.lit("Doc-"), "conv_id", F.lit(".pdf"))).when(by == 1, F.concat(F.lit("DOC-"), "conv_id")).otherwise(F.concat(F.lit("none-"), "conv_id"))
    pages = F.array((F.col("turn") + 1).cast("int"), F.lit(1), F.lit(0), F.lit(1), F.lit(99))
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), name.alias("doc_name"), pages.alias("page_indices"), F.col("text").alias("question"))


# Sources and sinks


@query
def s1_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page", F.md5("text").alias("text_md5"), "token_length")


@query
def s2_paginate(spark, sf_dir):
    return books.paginate(_documents(spark, sf_dir)).select("doc_id", "page", F.md5("text").alias("text_md5"), "token_length")


@query
def s5_read_index(spark, sf_dir):
    """Index files as written, some cut off in the middle and some without a name, read back."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("source") != "src3", F.concat(F.lit("Doc-"), "doc_id")).alias("doc_name"), F.col("source").alias("doc_description"))
    nodes = _nodes(_pages(spark, sf_dir))
    made = files.index_json(docs.join(tree.export_tree(nodes), "doc_id").join(tree.nodes_by_depth(nodes).groupBy("doc_id").agg(F.sum("n_nodes").alias("n")), "doc_id"))
    values = cut(made.select(F.when(F.col("n") == 2, F.left("value", (F.length("value") / 2).cast("int"))).otherwise(F.col("value")).alias("value")))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    values.write.text(path)
    index = cut(files.read_index(spark, path))
    counts = tree.flatten_tree(index).groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    return index.join(counts, "doc_id").select("doc_id", "doc_name", "doc_description", "n_nodes")


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of the book view; of every forty documents most share a name but for its case and ending."""
    n = F.col("doc_id")
    alone = (n % 400 < 40) & (n % 40 != 7)
    shared = F.concat(F.lit("Vol/"), n % 40, F.when(n % 3 == 0, ".PDF").otherwise(".pdf"))
    names = _documents(spark, sf_dir).select(n.cast("string").alias("doc_id"), F.when(alone, F.concat(F.lit("single-"), n, F.lit(".pdf"))).otherwise(shared).alias("doc_name"))
    return cut(names.join(tree.export_tree(_nodes(_pages(spark, sf_dir))), "doc_id"))


@query
def s3_list_sources(spark, sf_dir):
    """The files of one index each, as they are listed."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files.write_index(_filed(spark, sf_dir), path, a_file_each=True)
    return files.list_sources(spark, path, "*.json", "out", recursive=True).select("name", "stem", "output")


@query
def s4_write_index(spark, sf_dir):
    """Indexes written in both ways, broken and nameless ones put beside them, and read back."""
    docs, out = _filed(spark, sf_dir), None
    broken = docs.limit(1).select(F.explode(F.array(F.lit('{"doc_id": "0", "doc_name": "x", "structure": ['), F.lit('{"structure": []}'))).alias("value"))
    for mode in ("file", "line"):
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        files.write_index(docs, path, a_file_each=mode == "file")
        broken.repartition(2, "value").write.text(f"{path}/others")
        index = files.read_index(spark, path, a_file_each=mode == "file")
        counts = tree.flatten_tree(index).groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
        found = index.join(counts, "doc_id").select("doc_id", "doc_name", F.lit(mode).alias("mode"), "n_nodes")
        out = found if out is None else out.unionByName(found)
    return out


@query
def s6_upsert(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n"))
    return files.upsert(docs, docs.filter("n > 1000").withColumn("source", F.lit("new")))


@query
def s6_stored_upsert(spark, sf_dir):
    """Catalog and nodes stored, then replaced for long documents, of which every third comes without nodes; twice."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "source", (F.length("text") > 1000).alias("long"), F.lit("").alias("digest"))
    nodes = cut(_nodes(_pages(spark, sf_dir)).select("doc_id", "node_id", "title"))
    kept = store.Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=16)
    kept.upsert(docs, nodes)
    incoming = docs.filter("long").withColumn("source", F.lit("new"))
    for _ in range(2):
        kept.upsert(incoming, nodes.join(incoming.filter("cast(doc_id as bigint) % 3 <> 0").select("doc_id"), "doc_id", "left_semi"))
    counts = kept.read("nodes").groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    return kept.read("catalog").join(counts, "doc_id", "left").select("doc_id", "source", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


@query
def c7_incremental(spark, sf_dir):
    """The index of all documents, then again after one in twenty has got a further page: only these are built a second time."""
    pages, knobs = _pages(spark, sf_dir), build.Knobs(summaries=False)
    kept = store.Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=16)
    first = batch.update(kept, pages, knobs=knobs)
    more = pages.filter("cast(doc_id as bigint) % 20 = 7").groupBy("doc_id").agg((F.max("page") + 1).alias("page"))
    grown = pages.unionByName(books.with_tokens(more.withColumn("text", F.lit("one page more"))))
    second = batch.update(kept, grown, knobs=knobs)
    times = first.unionByName(second).groupBy("doc_id").agg(F.count("*").alias("times"))
    return kept.read("catalog").join(times, "doc_id").select("doc_id", "doc_name", "page_count", "times")


@query
def j7_not_indexed(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return files.left_anti_docs(docs.select("doc_id", "source"), docs.filter(F.length("text") > 1000))


@query
def s7_rebuild_catalog(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Doc-"), "doc_id").alias("doc_name"), F.when(F.col("source") != "src1", F.col("source")).alias("doc_description"), F.lit("[]").alias("structure_json"))
    counts = _pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("page_count")).filter("page_count > 1")
    return files.rebuild_catalog(docs, counts)


@query
def s8_run_report(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Doc-"), "doc_id").alias("name"), F.concat(F.lit("out/"), "doc_id", F.lit("_structure.json")).alias("output"), "text")
    return files.run_report(docs, docs.filter(F.length("text") > 1000))


# Scalars


@query
def p2_tag_page(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page", F.md5(scalars.tag_page("text", "page")).alias("tagged_md5"), F.md5(scalars.tag_page("text", "page", "\n")).alias("labelled_md5"))


@query
def p3_leaders(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page", F.md5(scalars.normalize_leaders("text")).alias("normal_md5"))


@query
def p4_physical_index(spark, sf_dir):
    """The tag of each page, and its first word, which often is the code of a heading."""
    tag, word = F.split(scalars.tag_page("text", "page"), "\n")[0], F.regexp_extract("text", r"^(\S+)", 1)
    return _pages(spark, sf_dir).select("doc_id", "page", scalars.parse_physical_index(tag).alias("tagged"), scalars.parse_physical_index(word, bare_int=True).alias("bare"), scalars.parse_physical_index(word).alias("strict"))


@query
def p5_page_number(spark, sf_dir):
    """The last word of each line of the tables of contents."""
    lines = _printed(_pages(spark, sf_dir))[0].select("doc_id", F.posexplode(rules.entry_lines("toc_content")).alias("k", "line"))
    return lines.select("doc_id", "k", scalars.parse_page_number(F.regexp_extract("line", r"(\S+)[ \t]*$", 1)).alias("page"))


@query
def p6_page_spec(spark, sf_dir):
    """All printed pages of a table of contents and the range of them; where none are printed, the first title, which is no page."""
    pages = _pages(spark, sf_dir)
    entries = _printed(pages)[1]
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "page"))), lambda x: x["page"].cast("string")), ",")
    made = entries.groupBy("doc_id").agg(listed.alias("listed"), F.min("page").alias("a"), F.max("page").alias("b"), F.min_by("title", "pos").alias("title"))
    spec = F.when(F.col("a").isNull(), F.col("title")).otherwise(F.concat("listed", F.lit(", "), "a", F.lit(" - "), "b"))
    read = scalars.parse_page_spec("spec", "n_pages")
    return made.withColumn("spec", spec).join(detect.doc_stats(pages), "doc_id").select("doc_id", F.array_join(read["pages"].cast("array<string>"), ",").alias("pages"), read["error"].alias("error"))


@query
def p7_page_list(spark, sf_dir):
    """Printed pages less two, and then less three: some are below 1, most stand twice."""
    entries = _printed(_pages(spark, sf_dir))[1].filter("page is not null")
    listed = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "page"))).alias("l"))
    given = F.concat(F.transform("l", lambda x: x["page"] - 2), F.transform("l", lambda x: x["page"] - 3))
    return listed.select("doc_id", F.array_join(scalars.clean_page_list(given).cast("array<string>"), ",").alias("pages"))


@query
def p8_validate(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    items = _headings(pages).withColumn("physical_index", F.col("physical_index") + (F.col("doc_id").cast("long") % 3).cast("int"))
    return mapping.validate_physical_index(items, detect.doc_stats(pages)).select("doc_id", "pos", "physical_index")


@query
def p9_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", scalars.doc_name("url").alias("name"), scalars.doc_stem("url").alias("stem"), scalars.safe_name("url").alias("safe"), scalars.source_path("url").alias("source_path"))


@query
def p10_json(spark, sf_dir):
    """The text of each turn as a model would answer it: in a fence, and by assistants with a comma too many."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct(F.col("text").alias("answer")))
    body = F.when(F.col("role") == "assistant", F.concat(F.left(body, F.length(body) - 1), F.lit(",}"))).otherwise(body)
    read = scalars.read_json(F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")), "answer string")
    return rows.select("conv_id", "turn", F.md5(read["answer"]).alias("answer_md5"))


@query
def p12_parent_code(spark, sf_dir):
    return _headings(_pages(spark, sf_dir)).select("doc_id", "pos", "structure", scalars.parent_code("structure").alias("parent"))


# Rules and tables of contents


@query
def r1_toc_flags(spark, sf_dir):
    return detect.toc_flags(_pages(spark, sf_dir), 4)


@query
def r3_toc_entries(spark, sf_dir):
    return _printed(_pages(spark, sf_dir))[1]


@query
def r4_headings(spark, sf_dir):
    return mapping.extract_headings(_pages(spark, sf_dir))


@query
def r6_locate(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected, entries = _printed(pages)
    return mapping.locate(entries, pages, without=build._toc_pages(detected))


@query
def w2_toc_runs(spark, sf_dir):
    flags = _pages(spark, sf_dir).select("doc_id", "page", (F.pmod(F.col("page") * 7 + F.col("doc_id").cast("int"), F.lit(5)) < 3).alias("is_toc"))
    return detect.find_toc_pages(flags, 2, 20).select("doc_id", F.array_join(F.col("toc_pages").cast("array<string>"), ",").alias("toc_pages"))


@query
def w3_detect_toc(spark, sf_dir):
    found = detect.detect_toc(_pages(spark, sf_dir))
    return found.select("doc_id", F.md5("toc_content").alias("content_md5"), F.array_join(F.col("toc_pages").cast("array<string>"), ",").alias("toc_pages"), "has_page_numbers")


# Mapping


@query
def j1_title_pairs(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected, entries = _printed(pages)
    return mapping.match_title_pairs(entries, _headings(pages), detected)


@query
def a3_page_offset(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected, entries = _printed(pages)
    return mapping.page_offset(mapping.match_title_pairs(entries, _headings(pages), detected))


@query
def u4_apply_offset(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected, entries = _printed(pages)
    offsets = mapping.page_offset(mapping.match_title_pairs(entries, _headings(pages), detected))
    return mapping.apply_offset(entries.withColumn("physical_index", F.lit(None).cast("int")), offsets).select("doc_id", "pos", "page", "physical_index")


@query
def w4_evenly_spaced(spark, sf_dir):
    return mapping.evenly_spaced(_printed(_pages(spark, sf_dir))[1], 8).select("doc_id", "pos")


@query
def w5_prefix(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return mapping.prefix_within_budget(pages, _printed(pages)[0], 6, GROUP_TOKENS)


@query
def w6_group_pages(spark, sf_dir):
    return mapping.group_pages(_pages(spark, sf_dir), GROUP_TOKENS)


def _bounds(pages: DataFrame) -> DataFrame:
    items = _headings(pages).join(detect.doc_stats(pages), "doc_id")
    return mapping.neighbour_bounds(items, F.col("pos") % 3 == 0, F.lit(0), F.col("n_pages"))


@query
def j2_neighbours(spark, sf_dir):
    return _bounds(_pages(spark, sf_dir)).select("doc_id", "pos", "prev_index", "next_index")


@query
def w7_resolve_window(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return mapping.resolve_window(_bounds(pages).select("doc_id", "pos", "prev_index", "next_index"), pages, GROUP_TOKENS)


@query
def w7_whole_window(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return mapping.resolve_window(_bounds(pages).select("doc_id", "pos", "prev_index", "next_index"), pages)


@query
def j3_range_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    out = mapping.range_text(_ranged(pages).select("doc_id", "pos", "start_index", "end_index"), pages, ["doc_id", "pos"], labels=True)
    return out.select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query
def u2_pages_needed(spark, sf_dir):
    return mapping.pages_needed(_ranged(_pages(spark, sf_dir)))


@query
def u3_append(spark, sf_dir):
    items = _headings(_pages(spark, sf_dir)).select("doc_id", "pos", "title")
    return mapping.append_items(items.filter("pos % 2 = 1"), items.filter("pos % 2 = 0"))


@query
def j8_title_places(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return mapping.title_places(_printed(pages)[1], pages)


# Verification


def _shifted(pages: DataFrame) -> DataFrame:
    """Headings with every fourth one a page too late."""
    return cut(_headings(pages).withColumn("physical_index", F.col("physical_index") + F.when(F.col("pos") % 4 == 3, 1).otherwise(0)))


@query
def r5_check_titles(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return verify.check_titles(_shifted(pages), pages).select("doc_id", "pos", "physical_index", "appears", "at_start")


@query
def a1_doc_stats(spark, sf_dir):
    return detect.doc_stats(_pages(spark, sf_dir))


@query
def a4_accuracy(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rates = verify.verify(_shifted(pages), pages, detect.doc_stats(pages))[1]
    return rates.select("doc_id", F.round("accuracy", 6).alias("accuracy"), "incorrect")


@query
def c4_repair(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    items, stats = _shifted(pages), cut(detect.doc_stats(pages))
    fixed, wrong = verify.repair(items, verify.check_titles(items, pages), pages, stats)
    return fixed.join(wrong.withColumn("still_wrong", F.lit(True)), ["doc_id", "pos"], "left").select("doc_id", "pos", "physical_index", F.coalesce("still_wrong", F.lit(False)).alias("still_wrong"))


@query
def a8_repair_report(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    items, stats = _shifted(pages), cut(detect.doc_stats(pages))
    fixed, wrong = verify.repair(items, verify.check_titles(items, pages), pages, stats)
    return verify.repair_report(items, fixed, wrong, stats)


@query
def c6_appear_start(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return verify.fill_appear_start(_shifted(pages), pages).select("doc_id", "pos", "appear_start")


@query
def w11_batches(spark, sf_dir):
    return verify.batch_pages(_pages(spark, sf_dir), 4)


@query
def w12_sample(spark, sf_dir):
    return verify.sample_items(_headings(_pages(spark, sf_dir)), 5).select("doc_id", "pos")


# Trees


@query
def u1_preface(spark, sf_dir):
    return tree.add_preface(_headings(_pages(spark, sf_dir))).select("doc_id", "pos", "structure", "title", "physical_index")


@query
def w1_ranges(spark, sf_dir):
    return _ranged(_pages(spark, sf_dir)).select("doc_id", "pos", "start_index", "end_index")


@query
def j4_parents(spark, sf_dir):
    return tree.resolve_parents(_ranged(_pages(spark, sf_dir))).select("doc_id", "pos", "structure", "parent_pos")


@query
def w10_paths(spark, sf_dir):
    return tree.build_tree(_ranged(_pages(spark, sf_dir))).select("doc_id", "pos", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "depth")


@query
def w9_node_ids(spark, sf_dir):
    return _nodes(_pages(spark, sf_dir)).select("doc_id", "pos", "node_id", "parent_seq", "is_leaf")


@query
def w8_large_nodes(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    ranges = pages.groupBy("doc_id").agg(F.max("page").alias("end_index")).withColumn("start_index", F.lit(1))
    return split.large_nodes(ranges, pages, MAX_PAGES, MAX_TOKENS).select("doc_id", "start_index", "end_index")


@query
def k3_leaf_text(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return enrich.add_node_text(_nodes(pages), pages).select("doc_id", "node_id", F.md5("text").alias("text_md5"))


@query
def a5_page_counts(spark, sf_dir):
    return tree.max_end_index(_nodes(_pages(spark, sf_dir)))


@query
def a6_child_titles(spark, sf_dir):
    found = tree.child_summaries(_summarized(spark, sf_dir))
    return found.select("doc_id", "node_seq", F.array_join("children.title", "|").alias("titles"), F.md5(F.array_join("children.summary", "|")).alias("summaries_md5"))


@query
def a7_depths(spark, sf_dir):
    return tree.nodes_by_depth(_nodes(_pages(spark, sf_dir)))


@query
def k5_summaries(spark, sf_dir):
    return _summarized(spark, sf_dir).select("doc_id", "node_id", "summary")


@query
def k6_descriptions(spark, sf_dir):
    return enrich.describe_documents(_summarized(spark, sf_dir))


@query
def p13_description_fields(spark, sf_dir):
    return tree.description_fields(_summarized(spark, sf_dir))


@query
def k2_k4_round_trip(spark, sf_dir):
    nodes = _nodes(_pages(spark, sf_dir))
    again = tree.flatten_tree(tree.export_tree(nodes))
    return again.select("doc_id", "node_id", "node_seq", "parent_seq", "depth", "title", "start_index", "end_index", "is_leaf")


@query
def k4_export(spark, sf_dir):
    return tree.export_tree(_nodes(_pages(spark, sf_dir)))


@query
def k7_split(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    whole = pages.groupBy("doc_id").agg(F.max("page").alias("end_index"))
    nodes = whole.select("doc_id", F.array(F.lit(0)).alias("path"), F.lit("Everything").alias("title"), F.lit(1).alias("start_index"), "end_index", F.lit(True).alias("is_leaf"))
    out = tree.write_node_ids(split.split_large(nodes, pages, MAX_PAGES, MAX_TOKENS).withColumn("depth", F.size("path") - 1))
    return out.select("doc_id", "node_id", "depth", "title", "start_index", "end_index", "is_leaf")


@query
def k7_answered(spark, sf_dir):
    """As k7_split, where a model is asked about each group of pages of a large node and gives every second heading of the document."""
    pages = _pages(spark, sf_dir)
    whole, groups = cut(detect.doc_stats(pages)), cut(mapping.group_pages(pages, MAX_TOKENS))
    item = F.struct("pos", "structure", "title", F.concat(F.lit("<physical_index_"), "physical_index", F.lit(">")).alias("physical_index"))
    first = groups.groupBy("doc_id", F.col("page").alias("physical_index")).agg(F.min("group_no").alias("group_no"))
    given = _headings(pages).filter("pos % 2 = 0").join(first, ["doc_id", "physical_index"])
    listed = given.groupBy("doc_id", "group_no").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("response"))
    asked = ask.make_requests("headings", cut(mapping.group_text(groups, pages)), ["group_no"])
    told = asked.join(listed, ["doc_id", "group_no"], "left").select("request_id", F.coalesce("response", F.lit('{"items": []}')).alias("response"))
    answers = ask.Answers(told)
    nodes = whole.select("doc_id", F.array(F.lit(0)).alias("path"), F.lit("Everything").alias("title"), F.lit(1).alias("start_index"), F.col("n_pages").alias("end_index"), F.lit(True).alias("is_leaf"))
    parts = split.split_large(nodes, pages, MAX_PAGES, MAX_TOKENS, answers=answers)
    out = tree.write_node_ids(parts.withColumn("depth", F.size("path") - 1))
    return out.select("doc_id", "node_id", "depth", "title", "start_index", "end_index", "is_leaf")


# Jobs


@query
def c1_path_a(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected = cut(detect.detect_toc(pages).filter("has_page_numbers"))
    return build.toc_with_pages(detected, pages).select("doc_id", "pos", "structure", "title", "page", "physical_index")


@query
def c2_path_b(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    detected, _ = _printed(pages)
    return build.toc_without_pages(detected, pages).select("doc_id", "pos", "structure", "title", "physical_index")


@query
def c5_cascade(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    found = build.resolve_toc(detect.detect_toc(pages), pages, cut(detect.doc_stats(pages)))
    return found.select("doc_id", "pos", "structure", "title", "physical_index", "path", "outcome")


@query
def c7_build_index(spark, sf_dir):
    return build.build_index(_pages(spark, sf_dir), knobs=build.Knobs(max_pages_per_node=MAX_PAGES, max_tokens_per_node=MAX_TOKENS))[0]


@query
def c7_section_tree(spark, sf_dir):
    """For every document the section tree with page ranges, ids and leaf text."""
    pages = _pages(spark, sf_dir)
    return enrich.add_node_text(_nodes(pages), pages).select("doc_id", "node_id", "depth", "title", "start_index", "end_index", "is_leaf", F.length("text").alias("text_chars"))


@query
def c8_list_documents(spark, sf_dir):
    docs = _catalog(spark, sf_dir).withColumn("structure_json", F.lit("[]"))
    return lookup.list_documents(docs, _nodes(_pages(spark, sf_dir)))


@query
def j5_find_documents(spark, sf_dir):
    return lookups.find_documents(_questions(spark, sf_dir), _catalog(spark, sf_dir)).select("request_id", "doc_id", "error")


def _page_requests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spec = F.when(F.col("turn") % 4 == 3, F.lit("5-3")).when(F.col("turn") % 2 == 0, F.lit("2-4,1")).otherwise(F.concat((F.col("turn") + 1).cast("string"), F.lit(",1")))
    doc = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("none-"), "conv_id")).otherwise(F.col("conv_id").cast("string"))
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), doc.alias("doc_id"), spec.alias("pages"))


@query
def c9_get_documents(spark, sf_dir):
    counts = _pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("page_count"))
    return lookup.get_documents(_page_requests(spark, sf_dir), _catalog(spark, sf_dir).drop("page_count").join(counts, "doc_id"))


@query
def c10_structures(spark, sf_dir):
    return lookup.get_structures(_questions(spark, sf_dir), _catalog(spark, sf_dir), _nodes(_pages(spark, sf_dir)))


@query
def c11_page_content(spark, sf_dir):
    found = lookup.get_page_content(_page_requests(spark, sf_dir), _catalog(spark, sf_dir), _pages(spark, sf_dir))
    body = F.array_join(F.transform("content", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["text"])), "\n")
    return found.select("request_id", "doc_id", F.md5(body).alias("content_md5"), "error")


@query
def c12_answer_requests(spark, sf_dir):
    found = lookup.answer_requests(_questions(spark, sf_dir), _catalog(spark, sf_dir), _pages(spark, sf_dir))
    return found.select("request_id", "doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.md5("prompt").alias("prompt_md5"), "error")


@query
def x1_requests(spark, sf_dir):
    made = ask.make_requests("toc_page", _pages(spark, sf_dir), ["page"])
    return made.select("request_id", "doc_id", "stage", "est_tokens", F.md5("prompt").alias("prompt_md5"))


@query
def x2_responses(spark, sf_dir):
    """For each page what a model might answer: to contents pages yes, to first pages their index, else no JSON at all."""
    pages = _pages(spark, sf_dir)
    yes, index = F.lit('{"answer": "Yes", "at_start": "yes"}'), F.lit('```json\n{"answer": None, "physical_index": "<physical_index_1>", "confidence": "high",}\n```')
    text = F.when(rules.is_toc_page("text"), yes).when(F.col("page") == 1, index).otherwise(F.col("text"))
    read = ask.parse_responses(pages.select(F.concat_ws("-", "doc_id", "page").alias("request_id"), text.alias("response")))
    return read.drop("items", "text")


@query
def x3_answers(spark, sf_dir):
    flags = detect.toc_flags(_pages(spark, sf_dir), 4).withColumn("request_id", F.concat_ws("-", "doc_id", "page"))
    given = flags.filter("page = 1").select("request_id", F.lit(True).alias("is_toc"))
    return ask.with_answers(flags, given, "is_toc").select("request_id", "is_toc")


def _contents_model(batches):
    """Stands for a user's model: a page is a table of contents if its text begins so."""
    for pdf in batches:
        yes = pdf["prompt"].str.contains("\n\nContents", regex=False)
        yield pdf.assign(response=yes.map({True: '{"answer": "yes"}', False: '{"answer": "no"}'}))[["request_id", "response"]]


@query
def x4_run_model(spark, sf_dir):
    """Answers to one request for each different page of a document, which by their key lead back to that page."""
    pages = _pages(spark, sf_dir)
    asked = cut(ask.make_requests("toc_page", pages, ["page"]))
    answers = ask.parse_responses(ask.run_model(asked, _contents_model)).filter("ok").select("request_id", F.col("answer").alias("is_toc"))
    ruled = asked.select("request_id", "doc_id", "page").join(pages.select("doc_id", "page", rules.is_toc_page("text").alias("is_toc"), F.md5("text").alias("text_md5")), ["doc_id", "page"])
    return ask.with_answers(ruled, answers, "is_toc").select("doc_id", "text_md5", "is_toc")


@query
def w3_answered(spark, sf_dir):
    """Detection where a model finds contents pages only if they have leaders: its answers override the rule for all others."""
    pages = _pages(spark, sf_dir)
    asked = pages.filter("page <= 20 and not contains(text, '.........')")
    answers = ask.Answers(ask.make_requests("toc_page", asked).select("request_id", F.lit('{"answer": "no"}').alias("response")))
    found = detect.detect_toc(pages, answers=answers)
    return found.select("doc_id", F.md5("toc_content").alias("content_md5"), F.array_join(F.col("toc_pages").cast("array<string>"), ",").alias("toc_pages"), "has_page_numbers")
