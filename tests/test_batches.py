"""Stored tables, batches with failing documents, incremental builds, requests and model runs."""

import json
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from doctree.functions import rules
from doctree.jobs import batch, build
from doctree.operators import enrich, mapping, requests as ask, tree, verify
from doctree.operators.pages import stored_pages
from doctree.sources import files, scratch, store

PAGES = "doc_id string, page int, text string, token_length int"


def pages_of(spark, docs):
    return spark.createDataFrame([(d, i + 1, t, len(t) // 4) for d, some in docs.items() for i, t in enumerate(some)], PAGES)


def local(path):
    return sorted(str(p) for p in path.rglob("*.parquet"))


def test_upserts_rewrite_their_buckets_only(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store", buckets=8)
    docs = spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.lit("old").alias("doc_name"), F.lit("x").alias("digest"))
    nodes = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("node_seq"))
    assert kept.read("catalog") is None and len(kept.upsert(docs, nodes)) == 8
    before = {p: os.stat(p).st_mtime_ns for p in local(tmp_path)}
    one = docs.filter("doc_id = '17'").withColumn("doc_name", F.lit("new"))
    for _ in range(2):
        touched = kept.upsert(one, nodes.filter("doc_id = '17' and node_seq = 0"))
        assert len(touched) == 1
        assert {r.doc_id: r.doc_name for r in kept.read("catalog").filter("doc_name = 'new'").collect()} == {"17": "new"}
        assert kept.read("catalog").count() == 200 and kept.read("nodes").count() == 598
    after = {p: os.stat(p).st_mtime_ns for p in local(tmp_path)}
    assert {p for p in before if f"bucket={touched[0]}/" not in p} == {p for p, t in after.items() if before.get(p) == t}
    # A bucket that loses its last node is empty afterwards.
    bucket = kept.read("catalog").filter(F.col("bucket") == touched[0]).drop("bucket")
    kept.upsert(bucket, nodes.limit(0))
    assert kept.read("nodes").filter(F.col("bucket") == touched[0]).count() == 0 and kept.read("catalog").count() == 200
    assert kept.upsert(docs.limit(0), nodes.limit(0)) == []


def test_one_document_that_fails_stops_no_other(spark):
    docs = {str(i): [f"1 Title{i}\nbody", "2 More\nbody"] for i in range(40)}
    poison = F.when(F.col("doc_id") == "13", F.raise_error(F.lit("poisoned")).cast("string")).otherwise(F.col("text"))
    pages = pages_of(spark, docs).withColumn("text", poison)

    def job(some):
        return scratch.keep(mapping.extract_headings(some))

    done = batch.isolate(pages, job)
    assert {r.doc_id for d in done.results for r in d.collect()} == set(docs) - {"13"}
    failed = done.failures.collect()
    assert [r.doc_id for r in failed] == ["13"] and "poisoned" in failed[0].error
    with pytest.raises(Exception, match="poisoned"):
        batch.isolate(pages.withColumn("text", F.raise_error(F.lit("poisoned")).cast("string")), job, most=3)
    whole = batch.isolate(pages_of(spark, docs), job)
    assert len(whole.results) == 1 and whole.failures.count() == 0
    sources = pages.select("doc_id").distinct().withColumns({"name": F.col("doc_id"), "output": F.lit("o")})
    report = files.run_report(sources, spark.createDataFrame([(d,) for d in docs if d != "13"], "doc_id string"), done.failures)
    assert [(r.doc_id, "poisoned" in r.error) for r in report.filter("status = 'failed'").collect()] == [("13", True)]
    assert tuple(files.run_failed(report).first()) == (40, 1, True)


def test_index_batch_and_update(spark, tmp_path):
    docs = {d: [f"1 One{d}\nbody", "2 Two\nbody"] for d in "abcd"}
    bad = lambda pages: pages.withColumn("text", F.when(F.col("doc_id") == "c", F.raise_error(F.lit("poisoned")).cast("string")).otherwise(F.col("text")))
    knobs = build.Knobs(summaries=False)
    kept = store.Store(spark, f"file://{tmp_path}/store", buckets=4)
    # The digest cannot be read either, so such a document has to be kept out before; here it fails later.
    pages = pages_of(spark, docs)
    index, nodes, failures = batch.index_batch(bad(pages), knobs=knobs)
    assert {r.doc_id for r in index.collect()} == set("abd") and [r.doc_id for r in failures.collect()] == ["c"]
    assert {r.doc_id for r in nodes.collect()} == set("abd")
    first = batch.update(kept, pages, knobs=knobs)
    assert {(r.doc_id, r.status) for r in first.collect()} == {(d, "built") for d in docs}
    assert batch.update(kept, pages, knobs=knobs).count() == 0
    docs["b"] = docs["b"] + ["3 Three\nbody"]
    second = batch.update(kept, pages_of(spark, docs), knobs=knobs)
    assert {(r.doc_id, r.status) for r in second.collect()} == {("b", "built")}
    stored = {r.doc_id: r for r in kept.read("catalog").collect()}
    assert stored["b"].page_count == 3 and "Three" in stored["b"].structure_json and stored["a"].page_count == 2
    told = spark.createDataFrame([("d", "r1", "{}")], "doc_id string, request_id string, response string")
    assert [r.doc_id for r in batch.update(kept, pages_of(spark, docs), knobs=knobs, told=told).collect()] == ["d"]
    assert batch.update(kept, pages_of(spark, docs), knobs=knobs, told=told).count() == 0


def test_build_index_leaves_its_results_only(spark):
    shared = pathlib.Path(scratch.shared_dir(spark).removeprefix("file://"))
    tables = lambda: set(shared.iterdir()) if shared.exists() else set()
    before = tables()
    index, nodes = build.build_index(pages_of(spark, {"a": ["1 One\nbody", "2 Two\nbody"]}))
    assert len(tables() - before) == 2 and index.count() == 1 and nodes.count() == 2
    with pytest.raises(Exception, match="poisoned"):
        build.build_index(pages_of(spark, {"a": ["x"]}).withColumn("text", F.raise_error(F.lit("poisoned")).cast("string")))
    assert len(tables() - before) == 2


def test_requests_are_written_once(spark):
    rows = [("a", i, "same" if i < 3 else f"text {i}") for i in range(12)] + [("b", 1, "same")]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    made = ask.make_requests("toc_page", pages, ["page"]).collect()
    assert len(made) == len({r.request_id for r in made}) == 11 and sorted(r.page for r in made if r.doc_id == "a" and "same" in r.prompt)[0] in (0, 1, 2)
    answers = ask.Answers(spark.createDataFrame([(made[0].request_id, '{"answer": "yes"}')], "request_id string, response string"))
    flags = pages.withColumn("is_toc", F.lit(False))
    for _ in range(2):
        out = answers.apply("toc_page", flags, ["page"], is_toc="answer")
        assert out.count() == 13 and out.filter("is_toc").count() == (3 if "same" in made[0].prompt and made[0].doc_id == "a" else 1)
    left = answers.open.collect()
    assert {r.request_id for r in left} == {r.request_id for r in made[1:]} and len(left) == 10
    assert all(json.loads(r.key)["page"] in range(12) for r in left)
    part = ask.PartAnswers(answers, lambda c: F.split(c, "#")[0])
    again = part.apply("toc_page", flags.withColumn("doc_id", F.concat("doc_id", F.lit("#7"))), ["page"], is_toc="answer")
    assert {r.doc_id for r in again.collect()} == {"a#7", "b#7"} and again.filter("is_toc").count() == out.filter("is_toc").count()
    assert answers.open.count() == 10
    none = ask.Answers(spark.createDataFrame([], "request_id string, response string"))
    assert none.open.count() == 0


def test_failing_requests_cost_no_others(spark):
    asked = spark.createDataFrame([(str(i), f"prompt {i}") for i in range(50)] + [("7", "prompt 7")], "request_id string, prompt string").coalesce(1)

    def model(frames):
        loaded = True
        for pdf in frames:
            if pdf["prompt"].str.contains("13").any():
                raise ValueError("cannot answer 13")
            assert loaded
            keep = pdf[~pdf["prompt"].str.endswith(" 20")]
            yield keep.assign(response=keep["prompt"].map(lambda p: "" if p.endswith(" 21") else p.upper()))

    got = {r.request_id: r for r in ask.run_model(asked, model, batch=8).collect()}
    assert len(got) == 50 and got["7"].response == "PROMPT 7" and got["7"].error is None
    assert got["13"].response is None and "cannot answer 13" in got["13"].error and got["12"].response == "PROMPT 12"
    assert got["20"].error == "no response" and got["21"].error == "no response"


def test_deep_trees_in_one_pass(spark):
    """A chain of 300 levels, codes out of order, repeated codes and gaps, against a plain walk."""
    rng = random.Random(1)
    codes = {"deep": [".".join(["1"] * k) for k in range(1, 301)], "odd": [rng.choice(["1", "2", "1.1", "1.2", "2.1", "1.1.1", "3.1.1", "", None]) for _ in range(300)]}
    items = spark.createDataFrame([(d, i, c, f"T{i}") for d, some in codes.items() for i, c in enumerate(some)], "doc_id string, pos int, structure string, title string")
    got = {(r.doc_id, r.pos): (r.parent_pos, r.path, r.depth) for r in tree.build_tree(items).collect()}
    gaps = {(r.doc_id, r.pos): r.parent_pos for r in tree.resolve_parents(items, repair_gaps=True).collect()}
    for d, some in codes.items():
        for i, c in enumerate(some):
            ups = [".".join((c or "").split(".")[:k]) for k in range((c or "").count("."), 0, -1)]
            up = next((j for j in range(i - 1, -1, -1) if ups and some[j] == ups[0]), None)
            path = (got[d, up][1] if up is not None else []) + [i]
            assert got[d, i] == (up, path, len(path) - 1)
            assert gaps[d, i] == next((j for u in ups for j in range(i - 1, -1, -1) if some[j] == u), None)
    again = tree.node_paths(tree.resolve_parents(items))
    assert {(r.doc_id, r.pos): r.path for r in again.collect()} == {k: v[1] for k, v in got.items()}
    nodes = tree.write_node_ids(tree.build_tree(items))
    rows = {(r.doc_id, tuple(r.path)): r for r in nodes.collect()}
    for d in codes:
        own = sorted(p for e, p in rows if e == d)
        for k, p in enumerate(own):
            r = rows[d, p]
            assert r.node_seq == k and r.node_id == f"{k:04d}" and r.is_leaf == (not any(q[: len(p)] == p for q in own[k + 1 : k + 2]))
            assert r.parent_seq == (own.index(p[:-1]) if len(p) > 1 else None)
    summed = enrich.summarize(nodes.withColumn("text", F.when(F.col("is_leaf"), F.col("title"))), keep_text=False)
    assert summed.filter("doc_id = 'deep' and depth = 0").first().summary.startswith("T1: T2: T3")


def test_clip_in_both_forms(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \t\né .") for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (1, 7, 20):
        assert [r.c for r in df.select(rules.clip("text", n).alias("c")).collect()] == [rules.clipped(t, n) for t in texts]


def test_text_of_ranges_over_blocks(spark):
    """Ranges inside a block, over many, at their edges, without pages, empty and null ones; the text has one exchange of its own."""
    pages = spark.createDataFrame([("a", i, f"p{i};", 1) for i in range(1, 400) if i % 50] + [("b", 1, None, 0)], PAGES)
    spans = [(1, 3), (63, 64), (64, 64), (1, 399), (127, 193), (50, 50), (398, 900), (500, 600), (9, 3), (None, 4), (-5, 2)]
    ranges = spark.createDataFrame([("a", k, f"keep{k}", s, e) for k, (s, e) in enumerate(spans)] + [("b", 0, "null", 1, 1), ("none", 0, "no", 1, 1)], "doc_id string, k int, more string, start_index int, end_index int")
    got = {(r.doc_id, r.k): (r.more, r.text) for r in mapping.with_range_text(ranges, pages, ["doc_id", "k"]).collect()}
    for k, (s, e) in enumerate(spans):
        assert got["a", k] == (f"keep{k}", "".join(f"p{i};" for i in range(s, e + 1) if 0 < i < 400 and i % 50) if s is not None else "")
    assert got["b", 0] == ("null", "") and got["none", 0] == ("no", "")
    tagged = {(r.doc_id, r.k): r.text for r in mapping.range_text(ranges, pages, ["doc_id", "k"], labels=True).collect()}
    assert tagged["a", 0] == "".join(f"<physical_index_{i}>\np{i};\n<physical_index_{i}>\n" for i in (1, 2, 3))


def test_stored_pages_are_not_shuffled(spark):
    """Checks of titles and texts of ranges go to stored blocks: the scan of the table has no exchange above it."""
    docs = {"a": [f"{i} Title{i}\nbody" for i in range(1, 200)], "b": ["1 Only\nbody"]}
    flat = pages_of(spark, docs)
    items = mapping.extract_headings(flat)
    ranges = spark.createDataFrame([("a", 0, 3, 5), ("a", 1, 60, 130), ("b", 0, 1, 1), ("c", 0, 1, 1)], "doc_id string, k int, start_index int, end_index int")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(keep, ("-1", "false")):
            spark.conf.set(c, v)
        with stored_pages(flat, buckets=3) as store:
            frames = [verify.check_titles(items, store), mapping.with_range_text(ranges.filter("k = 0"), store, ["doc_id", "k"]), mapping.pages_in_range(ranges, store)]
            name = store.blocks._jdf.queryExecution().analyzed().toString().split("doctree_pages_")[1][:32]
            for df in frames:
                scans = 0
                plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
                for at, line in enumerate(plan):
                    if name in line and "FileScan" in line:
                        scans += 1
                        depth = line.index("FileScan")
                        above = []
                        for up in reversed(plan[:at]):
                            own = len(up) - len(up.lstrip(" :+-*(0123456789)"))
                            if own < depth:
                                above.append(up)
                                depth = own
                        join = next(i for i, x in enumerate(above) if "Join" in x)
                        assert not any("Exchange" in x for x in above[:join]), "\n".join(plan)
                assert scans
            assert frames[0].filter("appears").count() == 200 and frames[2].count() == 3 + 71 + 1
            assert {(r.doc_id, r.k): len(r.text) for r in mapping.with_range_text(ranges, store, ["doc_id", "k"]).collect()} == {(r.doc_id, r.k): len(r.text) for r in mapping.with_range_text(ranges, flat, ["doc_id", "k"]).collect()}
            only = store.only(spark.createDataFrame([("b",)], "doc_id string"), 1)
            assert {r.doc_id for r in only.flat.select("doc_id").distinct().collect()} == {"b"}
            assert sorted(map(tuple, store.flat.collect())) == sorted(map(tuple, flat.collect()))
            path = pathlib.Path(scratch.shared_dir(spark).removeprefix("file://"))
            assert list(path.glob("*-pages"))
        assert not list(path.glob("*-pages")) and not [t for t in spark.catalog.listTables() if t.name.startswith("doctree_pages_")]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_asked_text_is_put_together_once(spark):
    docs = {d: [f"{i} Title {d}{i}\nbody" for i in range(1, 5)] for d in "abc"}
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    pages = pages_of(spark, docs).withColumn("text", F.udf(counted, "string")("text"))
    answers = ask.Answers(spark.createDataFrame([("r", "{}")], "request_id string, response string"))
    items = mapping.group_headings(pages, answers, 6)
    # The text of questions, and the headings of the rule, which a filter may read once more.
    assert items.count() == 12 and 24 <= seen.value <= 36, seen.value
    items = scratch.cut(mapping.extract_headings(pages_of(spark, docs)))
    seen.value = 0
    assert verify.check_titles(items, pages, answers).filter("appears").count() == 12
    assert seen.value == 12, seen.value


def test_update_shuffles_no_text_of_documents_that_stay(spark, tmp_path, monkeypatch):
    docs = {str(d): [f"1 One{d}\nbody", "2 Two\nbody"] for d in range(40)}
    plans, index_batch = [], batch.index_batch
    told = lambda some: plans.append(some._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(batch, "index_batch", lambda some, *rest: (told(some), index_batch(some, *rest))[1])
    kept, knobs = store.Store(spark, f"file://{tmp_path}/store", buckets=4), build.Knobs(summaries=False)
    assert batch.update(kept, pages_of(spark, docs), knobs=knobs).count() == 40
    docs["7"] = docs["7"] + ["3 Three\nbody"]
    assert [r.doc_id for r in batch.update(kept, pages_of(spark, docs), knobs=knobs).collect()] == ["7"]
    assert "Join" not in plans[0] and "bitmap_construct_agg" in plans[1] and "LeftSemi" in plans[1]
