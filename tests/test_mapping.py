import random

from pyspark.sql import functions as F

from doctree.functions import rules
from doctree.operators import detect, mapping, membership, verify


def pages_of(spark, docs):
    rows = [(d, i + 1, t, len(t) // 4) for d, texts in docs.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, page int, text string, token_length int")


def tokens_of(spark, docs):
    return spark.createDataFrame([(d, i + 1, n) for d, some in docs.items() for i, n in enumerate(some)], "doc_id string, page int, token_length int")


def test_toc_runs(spark):
    flags = {"none": [], "one": [2, 3], "gap": [1, 3], "end": [19, 20], "late": [21]}
    rows = [(d, p, p in some) for d, some in flags.items() for p in range(1, 25)]
    df = spark.createDataFrame(rows, "doc_id string, page int, is_toc boolean")
    assert {r.doc_id: r.toc_pages for r in detect.find_toc_pages(df).collect()} == {"one": [2, 3], "gap": [1], "end": [19, 20]}


def test_second_run_with_numbers_wins(spark):
    pages = pages_of(spark, {"a": ["cover", "Contents\nOne\nTwo", "text", "Contents\nOne: 1\nTwo: 2", "One"], "b": ["Contents\nOne", "x"], "c": ["x"]})
    got = {r.doc_id: (r.toc_pages, r.has_page_numbers, r.toc_content) for r in detect.detect_toc(pages).collect()}
    assert got["a"][:2] == ([4], True) and got["b"][:2] == ([1], False) and got["c"] == ([], False, None)


def test_offset(spark):
    rows = [("clear", i, f"t{i}", p, p + (5 if i == 1 else 2)) for i, p in enumerate([1, 2, 3, 4])]
    rows += [("tie", i, "t", 1, 1 + d) for i, d in enumerate([4, 2, 4, 2])]
    rows += [("few", i, "t", 1, 2) for i in range(2)]
    rows += [("nulls", 0, "t", 1, 3), ("nulls", 1, "t", None, 3), ("nulls", 2, "t", None, 3)]
    pairs = spark.createDataFrame(rows, "doc_id string, pair_order int, title string, page int, physical_index int")
    assert {r.doc_id: r.offset for r in mapping.page_offset(pairs).collect()} == {"clear": 2, "tie": 4, "nulls": 2}


def test_evenly_spaced(spark):
    rows = [(str(n), i) for n in (3, 8, 9, 100) for i in range(n)]
    got = mapping.evenly_spaced(spark.createDataFrame(rows, "doc_id string, pos int"), 8)
    by = {r.doc_id: sorted(r.p) for r in got.groupBy("doc_id").agg(F.collect_list("pos").alias("p")).collect()}
    for n in (3, 8, 9, 100):
        assert by[str(n)] == sorted(set(range(n)) if n <= 8 else {round(i * (n - 1) / 7) for i in range(8)})


def test_groups(spark):
    docs = {"small": [10, 10], "first": [500, 10, 10], "even": [100] * 10, "one": [5], "wide": [10, 400, 10, 400]}
    got = mapping.group_pages(tokens_of(spark, docs), 300).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r.doc_id, {}).setdefault(r.group_no, []).append(r.page)
    assert groups["small"] == {0: [1, 2]} and groups["one"] == {0: [1]}
    for d, some in groups.items():
        some = [sorted(some[g]) for g in sorted(some)]
        assert {p for g in some for p in g} == set(range(1, len(docs[d]) + 1))
        for a, b in zip(some, some[1:]):
            assert b[0] == a[-1]  # one page of overlap


def brute_window(tokens, budget):
    c = len(tokens) // 2
    chosen, total, left, right = [c], tokens[c], c - 1, c + 1
    open_left, open_right = left >= 0, right < len(tokens)
    while open_left or open_right:
        if open_right:
            if total + tokens[right] <= budget:
                chosen.append(right)
                total += tokens[right]
                right += 1
                open_right = right < len(tokens)
            else:
                open_right = False
        if open_left:
            if total + tokens[left] <= budget:
                chosen.append(left)
                total += tokens[left]
                left -= 1
                open_left = left >= 0
            else:
                open_left = False
    return min(chosen), max(chosen)


def test_windows(spark):
    rng = random.Random(4)
    docs = {f"d{i}": [rng.randint(0, 50) for _ in range(rng.randint(1, 15))] for i in range(30)}
    bounds = spark.createDataFrame([(d, 0, 0, len(t)) for d, t in docs.items()] + [("d0", 1, 5, 2)], "doc_id string, pos int, prev_index int, next_index int")
    got = {r.doc_id: (r.first_page - 1, r.last_page - 1) for r in mapping.resolve_window(bounds, tokens_of(spark, docs), 90).collect()}
    assert got == {d: brute_window(t, 90) for d, t in docs.items()}
    whole = {r.doc_id: (r.first_page, r.last_page) for r in mapping.resolve_window(bounds, tokens_of(spark, docs)).collect()}
    assert whole == {d: (1, len(t)) for d, t in docs.items()}


def test_neighbours(spark):
    items = spark.createDataFrame([("a", 0, None), ("a", 1, 4), ("a", 2, None), ("a", 3, None), ("a", 4, 9), ("b", 0, None)], "doc_id string, pos int, physical_index int")
    got = mapping.neighbour_bounds(items, F.col("physical_index").isNotNull(), F.lit(0), F.lit(20)).filter("physical_index is null")
    assert {(r.doc_id, r.pos): (r.prev_index, r.next_index) for r in got.collect()} == {("a", 0): (0, 4), ("a", 2): (4, 9), ("a", 3): (4, 9), ("b", 0): (0, 20)}


def test_locate(spark):
    pages = pages_of(spark, {"a": ["x", "One Two\nbody", "body\nONE  two", "1.3 Three"], "b": ["Same", "Same"]})
    items = spark.createDataFrame([("a", 0, "one two"), ("a", 1, "Three"), ("a", 2, "absent"), ("a", 3, ""), ("b", 0, "same")], "doc_id string, pos int, title string")
    got = {(r.doc_id, r.pos): (r.physical_index, r.confidence) for r in mapping.locate(items, pages).collect()}
    assert got == {("a", 0): (2, "high"), ("a", 1): (4, "high"), ("a", 2): (None, "low"), ("a", 3): (None, "low"), ("b", 0): (1, "low")}


def test_markdown_headings(spark):
    pages = pages_of(spark, {"a": ["# A\n## B\ntext", "## C\n### D\n# E", "Chapter 3: F\n2.1 G title"]})
    got = [(r.structure, r.title, r.physical_index) for r in mapping.extract_headings(pages).orderBy("pos").collect()]
    assert got == [("1", "A", 1), ("1.1", "B", 1), ("1.2", "C", 2), ("1.2.1", "D", 2), ("2", "E", 2), ("3", "Chapter 3: F", 3), ("2.1", "G title", 3)]


def test_accuracy_and_repair(spark):
    texts = ["Alpha\nx", "Beta\nx", "Gamma\nx", "Delta\nx"]
    pages = pages_of(spark, {"good": texts, "fix": texts, "short": texts})
    names = ["Alpha", "Beta", "Gamma", "Delta"]
    rows = [("good", i, t, i + 1) for i, t in enumerate(names)] + [("fix", i, t, [1, 4, 3, 4][i]) for i, t in enumerate(names)] + [("short", 0, "Alpha", 1)]
    items = spark.createDataFrame(rows, "doc_id string, pos int, title string, physical_index int").withColumns({"structure": F.lit("1"), "page": F.lit(None).cast("int"), "appear_start": F.lit(None).cast("boolean")})
    stats = detect.doc_stats(pages)
    checks, rates = verify.verify(items, pages, stats)
    assert {r.doc_id: (r.accuracy, r.incorrect) for r in rates.collect()} == {"good": (1.0, 0), "fix": (0.75, 1), "short": (0.0, 0)}
    fixed, wrong = verify.repair(items, checks, pages, stats)
    assert {(r.doc_id, r.pos): r.physical_index for r in fixed.collect()}["fix", 1] == 2 and wrong.count() == 0
    report = {r.doc_id: (r.fixed, r.invalid, r.truncated) for r in verify.repair_report(items, fixed, wrong, stats).collect()}
    assert report == {"good": (0, 0, 0), "fix": (1, 0, 0), "short": (0, 0, 0)}


def test_index_out_of_range_is_not_found(spark):
    pages = pages_of(spark, {"a": ["Alpha"]})
    items = spark.createDataFrame([("a", 0, "Alpha", 0), ("a", 1, "Alpha", -1), ("a", 2, "Alpha", 5)], "doc_id string, pos int, title string, physical_index int")
    assert not any(r.appears for r in verify.check_titles(items, pages).collect())
    capped = mapping.validate_physical_index(items, detect.doc_stats(pages))
    assert [r.physical_index for r in capped.orderBy("pos").collect()] == [0, -1, None]


def test_titles_meet_few_unwanted_lines(spark):
    """The bitmap lets every wanted line through, and at most one in fifty of the others; one very long title changes nothing."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = {d: [word() for _ in range(400)] for d in "abc"}
    pages = pages_of(spark, {d: ["\n".join(some[i : i + 10]) for i in range(0, 400, 10)] for d, some in lines.items()})
    items = [(d, i, t) for d, some in lines.items() for i, t in enumerate(some[::40])] + [("a", 99, "x" * 10_000), ("a", 100, "nowhere")]
    titles = spark.createDataFrame(items, "doc_id string, pos int, title string")
    wanted = titles.selectExpr("doc_id", "pos", "title as norm")
    passed = mapping._wanted_lines(wanted, pages, wanted.count())
    assert passed.join(wanted, ["doc_id", "norm"], "left_semi").count() == 30
    assert 30 <= passed.count() <= 30 + 1200 // 50
    assert mapping.title_places(titles, pages).count() == 30
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the bitmap's own rows


def test_bitmaps_of_any_size(spark):
    assert [membership.bitmap_rows(n) for n in (0, 1, 512, 513, 1 << 21, 1 << 27, (1 << 27) + 1)] == [1, 1, 1, 2, 4096, 4096, 0]
    df = spark.range(5000).selectExpr("id", "cast(id as string) as s")
    keys = df.filter("id % 10 = 0 or id is null")
    for n in (1, 500, 1 << 28):
        kept = {r.id for r in membership.likely_members(df, keys, ["id", "s"], n).collect()}
        assert kept >= set(range(0, 5000, 10)) and (n == 1 or n > 1 << 27 or len(kept) < 600)
    assert membership.likely_members(df, keys.limit(0), ["id"], 0).count() == 0


def test_absurd_page_numbers(spark):
    detected = spark.createDataFrame([("a", "One ..... 99999999999999999999\nTwo: 4294967296\nThree: 0000000000003", [1], True)], "doc_id string, toc_content string, toc_pages array<int>, has_page_numbers boolean")
    entries = detect.toc_entries(detected.withColumn("toc_content", F.replace("toc_content", F.lit(" ....."), F.lit(":"))))
    assert [(r.title, r.page) for r in entries.orderBy("pos").collect()] == [("One", 2147483647), ("Two", 2147483647), ("Three", 3)]
    assert detected.select(rules.has_page_numbers("toc_content")).first()[0]
    offsets = spark.createDataFrame([("a", 2)], "doc_id string, offset int")
    moved = mapping.apply_offset(entries.withColumn("physical_index", F.lit(None).cast("int")), offsets).orderBy("pos").collect()
    assert [(r.page, r.physical_index) for r in moved] == [(None, 2147483647), (None, 2147483647), (None, 5)]
    stats = spark.createDataFrame([("a", 9)], "doc_id string, n_pages int")
    kept = mapping.validate_physical_index(spark.createDataFrame(moved, "doc_id string, pos int, structure string, title string, page int, physical_index int"), stats)
    assert [r.physical_index for r in kept.orderBy("pos").collect()] == [None, None, 5]
    pairs = spark.createDataFrame([("a", i, "t", -2147483647, 2147483647) for i in range(3)], "doc_id string, pair_order int, title string, page int, physical_index int")
    assert mapping.page_offset(pairs).first().offset == 2147483647
