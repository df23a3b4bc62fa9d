import json

import pytest
from pyspark.sql import functions as F

from doctree.jobs import build, lookup
from doctree.operators import catalog as lookups
from doctree.operators import enrich, requests as ask, split, tree, verify
from doctree.sources import books, files


def items_of(spark, codes, doc="a"):
    return spark.createDataFrame([(doc, i, c, f"T{i}", i + 1) for i, c in enumerate(codes)], "doc_id string, pos int, structure string, title string, physical_index int")


def test_parents(spark):
    cases = {"plain": ["1", "1.1", "1.2", "2"], "gap": ["1", "1.1.1"], "twice": ["1", "1", "1.1"], "early": ["1.1", "1"], "null": [None, "1"], "preface": ["0", "0.1"]}
    rows = [(d, i, c) for d, codes in cases.items() for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, structure string")
    got: dict = {}
    for r in tree.resolve_parents(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.parent_pos)
    assert got == {"plain": [None, 0, 0, None], "gap": [None, None], "twice": [None, None, 1], "early": [None, None], "null": [None, None], "preface": [None, 0]}
    gaps = {(r.doc_id, r.pos): r.parent_pos for r in tree.resolve_parents(df, repair_gaps=True).collect()}
    assert gaps["gap", 1] == 0 and gaps["plain", 1] == 0


def test_preface_and_ranges(spark):
    rows = [("one", 0, 1, False), ("one", 1, 3, True), ("one", 2, 3, False), ("late", 0, 3, False), ("null", 0, None, False)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, physical_index int, appear_start boolean").withColumns({"structure": F.lit("1"), "title": F.lit("t")})
    with_preface = tree.add_preface(df)
    assert {(r.doc_id, r.pos): r.title for r in with_preface.collect()} == {("one", 0): "t", ("one", 1): "t", ("one", 2): "t", ("late", 0): "Preface", ("late", 1): "t", ("null", 0): "t"}
    ends = spark.createDataFrame([("one", 9), ("late", 9), ("null", 9)], "doc_id string, end_page int")
    got = {(r.doc_id, r.pos): (r.start_index, r.end_index) for r in tree.assign_ranges(df, ends).collect()}
    assert got["one", 0] == (1, 2) and got["one", 1] == (3, 3) and got["one", 2] == (3, 9)


def test_ids_of_many_nodes(spark):
    df = spark.range(10_002).select(F.lit("a").alias("doc_id"), F.array(F.col("id").cast("int")).alias("path"), F.lit(0).alias("depth"))
    ids = tree.write_node_ids(df)
    assert ids.filter("node_id = '0000' and path[0] = 0").count() == 1 and ids.filter("node_id = '10001'").count() == 1


def test_golden_round_trip(spark):
    """21 nodes, 11 of them roots, three with 2, 5 and 3 children, 12 pages, ids in depth-first order."""
    kids = {1: 2, 3: 5, 6: 3}
    roots = []
    for i in range(11):
        node = {"title": f"R{i}", "start_index": i + 1, "end_index": i + 2}
        if i in kids:
            node["nodes"] = [{"title": f"R{i}.{k}", "start_index": i + 1, "end_index": i + 2} for k in range(kids[i])]
        roots.append(node)
    docs = spark.createDataFrame([("a", json.dumps(roots)), ("bad", "{"), ("none", None)], "doc_id string, structure_json string")
    flat = tree.flatten_tree(docs)
    assert flat.count() == 21 and flat.filter("depth = 0").count() == 11 and flat.agg(F.max("depth")).first()[0] == 1
    assert tree.max_end_index(flat).first().page_count == 12
    numbered = tree.write_node_ids(flat.drop("node_seq", "node_id", "parent_seq", "is_leaf"))
    assert [r.node_id for r in numbered.orderBy("node_seq").collect()] == [f"{i:04d}" for i in range(21)]
    out = tree.export_tree(numbered)
    again = tree.export_tree(tree.flatten_tree(out))
    assert out.first().structure_json == again.first().structure_json
    first = json.loads(out.first().structure_json)[1]
    assert list(first) == ["title", "node_id", "start_index", "end_index", "nodes"] and "nodes" not in first["nodes"][0]


def test_leaf_text_and_summaries(spark):
    pages = spark.createDataFrame([("a", i, f"page {i} ", 2) for i in range(1, 5)], "doc_id string, page int, text string, token_length int")
    rows = [("a", 0, None, 0, "Root", 1, 1, False), ("a", 1, 0, 1, "L1", 1, 2, True), ("a", 2, 0, 1, "L2", 3, 2, True), ("a", 3, None, 0, "L3", None, None, True)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_seq int, parent_seq int, depth int, title string, start_index int, end_index int, is_leaf boolean")
    with_text = enrich.add_node_text(nodes, pages)
    assert {r.node_seq: r.text for r in with_text.collect()} == {0: None, 1: "page 1 page 2 ", 2: "", 3: None}
    got = {r.node_seq: r.summary for r in enrich.summarize(with_text).collect()}
    assert got == {0: "L1: page 1 page 2; L2", 1: "page 1 page 2", 2: "", 3: ""}


def test_split(spark):
    texts = ["1 Big\nx", "1.1 One\nx", "x", "1.2 Two\nx", "x"]
    pages = spark.createDataFrame([(d, i + 1, t, 100) for d in ("match", "other", "plain") for i, t in enumerate(texts if d != "plain" else ["x"] * 5)], "doc_id string, page int, text string, token_length int")
    nodes = spark.createDataFrame([(d, [0], t, 1, 5, True) for d, t in (("match", " Big "), ("other", "Else"), ("plain", "Big"))], "doc_id string, path array<int>, title string, start_index int, end_index int, is_leaf boolean")
    assert split.large_nodes(nodes, pages, 4, 1).count() == 0 and split.large_nodes(nodes, pages, 3, 501).count() == 0
    got = {(r.doc_id, r.title): (r.start_index, r.end_index, r.is_leaf) for r in split.split_large(nodes, pages, 3, 500).collect()}
    assert got["match", " Big "] == (1, 2, False) and got["match", "One"] == (2, 3, True) and got["match", "Two"] == (4, 5, True) and ("match", "Big") not in got
    assert got["other", "Else"] == (1, 1, False) and got["plain", "Big"] == (1, 5, True)


def test_split_goes_on_until_nothing_is_large(spark):
    texts = ["1 Top\nx", "2 Next\nx"] + [f"{'.'.join(['2'] * k)} L{k}\nx" for k in range(2, 9)] + ["x"] * 8
    same = ["1 A\n2 B", "x", "x", "x", "x"]
    pages = spark.createDataFrame([(d, i + 1, t, 100) for d, some in (("deep", texts), ("same", same)) for i, t in enumerate(some)], "doc_id string, page int, text string, token_length int")
    nodes = spark.createDataFrame([("deep", [0], "All", 1, len(texts), True), ("same", [0], "All", 1, 5, True)], "doc_id string, path array<int>, title string, start_index int, end_index int, is_leaf boolean")
    got = split.split_large(nodes, pages, 2, 100).collect()
    titles = [r.title for r in got if r.doc_id == "deep"]
    assert {f"L{k}" for k in range(2, 9)} < set(titles) and len([r for r in got if r.is_leaf and r.doc_id == "deep" and r.end_index - r.start_index > 2]) <= 1
    assert {"A", "B"} <= {r.title for r in got if r.doc_id == "same"} and len(got) < 60
    inner = spark.createDataFrame([("deep", [0], "All", 1, 9, False), ("deep", [0, 3], "Old", 9, 9, True)], nodes.schema)
    kept = {r.title for r in split.split_large(inner, pages, 2, 100).collect()}
    again = {r.title for r in split.split_large(inner, pages, 2, 100, split_internal=True).collect()}
    assert kept == {"All", "Old"} and "Old" not in again and "Top" in again


def test_index_files(spark, tmp_path):
    index = spark.createDataFrame([("a", "Dir/Doc A.pdf", None, '[{"title": "x \\"é\\"", "nodes": [{"title": "y"}]}]'), ("b", "Doc B.pdf", "d", "[]")], "doc_id string, doc_name string, doc_description string, structure_json string")
    for each in (False, True):
        path = tmp_path / f"index{each}"
        files.write_index(index, f"file://{path}", a_file_each=each)
        (path / "broken.json").write_text('{"doc_id": "c", "doc_name": "C", "structure": [')
        (path / "nameless.json").write_text('{"doc_id": "d", "structure": []}')
        (path / "bare.json").write_text('{"doc_name": "E", "structure": [{"title": "z",\n "nodes": []}]}' if each else '{"doc_name": "E", "structure": [{"title": "z"}]}')
        got = {r.doc_id: (r.doc_name, r.doc_description) for r in files.read_index(spark, f"file://{path}", a_file_each=each).collect()}
        assert got == {"a": ("Dir/Doc A.pdf", None), "b": ("Doc B.pdf", "d"), "E": ("E", None)}
        flat = tree.flatten_tree(files.read_index(spark, f"file://{path}", a_file_each=each))
        assert sorted((r.doc_id, r.title, r.depth) for r in flat.collect()) == [("E", "z", 0), ("a", 'x "é"', 0), ("a", "y", 1)]
    assert sorted(p.name for p in (tmp_path / "indexTrue").glob("part-*/*")) == ["Dir-Doc A_structure.json", "Doc B_structure.json"]


def test_files_of_equal_stems(spark, tmp_path):
    """Every document comes back, whatever its name; failed tasks and failed jobs leave nothing, and what was there stays."""
    names = ["x.pdf", "X.PDF", "b-x.pdf", "b/x.txt", None, "", "..", "é" * 300 + ".pdf", "é" * 300 + ".txt", "y-" + "0" * 24, 'a"b\\c|d.pdf']
    index = spark.createDataFrame([(str(i), n, None, "[]") for i, n in enumerate(names)], "doc_id string, doc_name string, doc_description string, structure_json string")
    path = tmp_path / "each"
    for _ in range(2):
        files.write_index(index.repartition(3), f"file://{path}", a_file_each=True)
        assert len(list(path.glob("part-*/*.json"))) == len(names) and (path / "_SUCCESS").exists()
    got = files.read_index(spark, f"file://{path}", a_file_each=True)
    assert {(r.doc_id, r.doc_name) for r in got.collect()} == {(str(i), n) for i, n in enumerate(names) if n is not None}
    files.write_index(index.limit(1).withColumn("doc_id", F.lit("new")), f"file://{path}", "append", a_file_each=True)
    assert len(list(path.glob("part-*/*.json"))) == len(names) + 1
    bad = index.withColumn("doc_description", F.when(F.col("doc_id") == "7", F.raise_error(F.lit("poisoned")).cast("string")))
    with pytest.raises(Exception, match="poisoned"):
        files.write_index(bad, f"file://{path}", a_file_each=True)
    assert len(list(path.glob("part-*/*.json"))) == len(names) + 1 and not list(path.glob("_staging*"))


def test_answers_replace_rules_in_the_whole_job(spark):
    pages = spark.createDataFrame([("a", 1, "1 One\nbody", 5), ("a", 2, "2 Two\nbody", 5), ("b", 1, "1 Other\nbody", 5)], "doc_id string, page int, text string, token_length int")
    none = spark.createDataFrame([], "request_id string, response string")
    knobs = build.Knobs(max_pages_per_node=3)
    first = ask.Answers(none)
    plain, _ = build.build_index(pages, knobs=knobs)
    asked_index, _ = build.build_index(pages, knobs=knobs, answers=first)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, asked_index.collect()))
    wanted = {(r.doc_id, r.stage): r.request_id for r in first.open.collect()}
    assert {s for _, s in wanted} >= {"toc_page", "headings", "appears", "summary", "description"}
    told = [
        (wanted["a", "headings"], '{"items": [{"structure": "1", "title": "One", "physical_index": "<physical_index_1>"}, {"structure": "1.1", "title": "Two", "physical_index": 2}]}'),
        (wanted["b", "description"], '```json\n{"text": "About others",}\n```'),
        (wanted["b", "headings"], "no JSON"),
    ]
    second = ask.Answers(spark.createDataFrame(told, none.schema))
    index, nodes = build.build_index(pages, knobs=knobs, answers=second)
    got = {r.doc_id: r for r in index.collect()}
    tree_a = json.loads(got["a"].structure_json)
    assert [n["title"] for n in tree_a] == ["One"] and [n["title"] for n in tree_a[0]["nodes"]] == ["Two"]
    assert got["b"].doc_description == "About others" and "Other" in got["b"].structure_json
    assert not {t[0] for t in told} & {r.request_id for r in second.open.collect()}


def test_build_index_on_books(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    pages = books.books(docs)
    index, nodes = build.build_index(pages, knobs=build.Knobs(max_pages_per_node=3, max_tokens_per_node=300))
    index, nodes = index.cache(), nodes.cache()
    assert index.count() == 60
    for r in nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list("node_seq")).alias("s"), F.bool_and(F.coalesce(F.col("parent_seq") < F.col("node_seq"), F.lit(True))).alias("ok")).collect():
        assert r.s == list(range(len(r.s))) and r.ok
    kept = nodes.filter("depth = 0").groupBy("doc_id").count().count()
    assert kept > 50
    assert all(json.loads(r.structure_json) is not None for r in index.collect())


def test_cascade_paths(spark):
    body = [f"{i} Title{i} word\nbody text" for i in range(1, 7)]
    toc = "Contents\n" + "\n".join(f"{i} Title{i} word ..... {i}" for i in range(1, 7))
    bare = "Contents\n" + "\n".join(f"{i} Title{i} word" for i in range(1, 7))
    wrong = "Contents\n" + "\n".join(f"{i} Nothing{i} ..... {i}" for i in range(1, 7))
    docs = {"A": ["cover", toc, *body], "bare": ["cover", bare, *body], "wrong": ["cover", wrong, *body], "none": body, "empty": ["text only"]}
    pages = spark.createDataFrame([(d, i + 1, t, len(t) // 4) for d, some in docs.items() for i, t in enumerate(some)], "doc_id string, page int, text string, token_length int")
    from doctree.operators import detect

    got: dict = {}
    for r in build.resolve_toc(detect.detect_toc(pages), pages, detect.doc_stats(pages)).orderBy("pos").collect():
        got.setdefault(r.doc_id, []).append((r.path, r.outcome, r.physical_index))
    assert got["A"] == [("A", "accepted", i + 2) for i in range(1, 7)]
    assert got["bare"] == [("C", "accepted", i + 2) for i in range(1, 7)]
    assert got["wrong"] == [("C", "accepted", i + 2) for i in range(1, 7)]
    assert got["none"] == [("C", "accepted", i) for i in range(1, 7)] and "empty" not in got


def test_sources_and_lookups(spark, tmp_path):
    index = spark.createDataFrame([("a", "Doc A.pdf", None, "[]"), ("b", "Doc B.pdf", "d", "[]")], "doc_id string, doc_name string, doc_description string, structure_json string")
    files.write_index(index, f"file://{tmp_path}/index")
    (tmp_path / "index" / "broken.json").write_text('{"doc_id": "c"}\n{"doc_id"\n')
    assert {r.doc_id for r in files.read_index(spark, f"file://{tmp_path}/index").collect()} == {"a", "b"}
    (tmp_path / "x.pdf").write_text("x")
    (tmp_path / "y.txt").write_text("y")
    assert [(r.name, r.output) for r in files.list_sources(spark, f"file://{tmp_path}", out_dir="out").collect()] == [("x.pdf", "out/x_structure.json")]
    new = index.filter("doc_id = 'b'").withColumn("doc_description", F.lit("new"))
    once = files.upsert(index, new)
    assert sorted(map(tuple, files.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))
    catalog = files.rebuild_catalog(index, spark.createDataFrame([("a", 3)], "doc_id string, page_count int")).withColumn("path", F.col("doc_id"))
    asked = spark.createDataFrame([("1", "Doc A.pdf"), ("2", "DOC a.PDF"), ("3", "nope"), ("4", None)], "request_id string, doc_name string")
    got = {r.request_id: (r.doc_id, r.error) for r in lookups.find_documents(asked, catalog).collect()}
    assert got["1"] == ("a", None) and got["2"] == ("a", None) and got["3"][0] is None and "nope" in got["3"][1] and got["4"][1]
    report = files.run_report(index.select("doc_id", F.col("doc_name").alias("name"), F.lit("o").alias("output")), index.filter("doc_id = 'a'"))
    assert tuple(files.run_failed(report).first()) == (2, 1, True)
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two")], "doc_id string, page int, text string")
    questions = spark.createDataFrame([("1", "Doc A.pdf", [2, 1, 9], "q"), ("2", "Doc A.pdf", [9], "q"), ("3", "Doc A.pdf", [0], "q"), ("4", "zz", [1], "q")], "request_id string, doc_name string, page_indices array<int>, question string")
    out = {r.request_id: r for r in lookup.answer_requests(questions, catalog, pages).collect()}
    assert out["1"].pages == [2, 1] and out["1"].prompt.index("two") < out["1"].prompt.index("one")
    assert out["2"].error == out["3"].error == "no valid page" and "unknown" in out["4"].error


def test_model_answers_override_rules(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "Contents")], "doc_id string, page int, text string")
    wanted = ask.make_requests("toc_page", pages.unionByName(pages))
    assert wanted.count() == 2

    def model(batches):
        for pdf in batches:
            yield pdf.assign(response=['{"answer": "yes"}' if "\n\nx" in p else "" for p in pdf["prompt"]])[["request_id", "response"]]

    answers = ask.parse_responses(ask.run_model(wanted, model))
    assert sorted((r.answer, r.ok) for r in answers.filter("ok").collect()) == [(True, True)]
    ruled = wanted.select("request_id").withColumn("is_toc", F.lit(False))
    given = answers.filter("ok").select("request_id", F.col("answer").alias("is_toc"))
    assert sorted(r.is_toc for r in ask.with_answers(ruled, given, "is_toc").collect()) == [False, True]


def test_batches(spark):
    pages = spark.createDataFrame([("a", i) for i in range(1, 8)], "doc_id string, page int")
    assert sorted(map(tuple, verify.batch_pages(pages, 3).groupBy("batch").count().collect())) == [(0, 3), (1, 3), (2, 1)]
    assert verify.batch_pages(pages, 0).select("batch").distinct().count() == 7
