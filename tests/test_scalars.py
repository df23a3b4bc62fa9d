from pyspark.sql import functions as F

from doctree.functions import rules, scalars


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(spark, f, values, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_count_tokens(spark):
    assert applied(spark, scalars.count_tokens, [None, "", "abc", "abcd", "é" * 9]) == [0, 0, 0, 1, 2]


def test_leaders(spark):
    given = ["a....b", "a.....b", "a . . . . . 3", "a . . . . . .3", "a . . . . .3", None]
    assert applied(spark, scalars.normalize_leaders, given) == ["a....b", "a: b", "a : 3", "a : 3", "a . . . . .3", None]


def test_physical_index(spark):
    given = ["<physical_index_7>", "physical_index_7", "7", " 7 ", "x", "<physical_index_x>", None, ""]
    assert applied(spark, scalars.parse_physical_index, given) == [7, 7, None, None, None, None, None, None]
    assert applied(spark, lambda c: scalars.parse_physical_index(c, bare_int=True), given) == [7, 7, 7, 7, None, None, None, None]


def test_page_number(spark):
    given = ["5", " 12 ", "iv", "", None, "-3", "+4", "0001234567890123", "9999999999", "-99999999999999999999999999999999999999999"]
    assert applied(spark, scalars.parse_page_number, given) == [5, 12, None, None, None, -3, 4, 2147483647, 2147483647, -2147483647]
    assert applied(spark, scalars.parse_physical_index, ["<physical_index_0002147483646>", "<physical_index_2147483648>"]) == [2147483646, 2147483647]


def test_page_spec(spark):
    given = ["3", "5-7", "3,8,12", "3,3,1", " 4 - 6 ", "7-5", "-5", "a", "", None]
    got = applied(spark, lambda c: scalars.parse_page_spec(c, F.lit(12)), given)
    assert [r["pages"] for r in got] == [[3], [5, 6, 7], [3, 8, 12], [1, 3], [4, 5, 6], None, None, None, None, None]
    assert [bool(r["error"]) for r in got] == [False] * 5 + [True] * 5
    assert "start after end" in got[5]["error"]
    # A range makes no more pages than there are.
    far = ["1-999999999", "2-99999999999999999999", "8,1-12345678901", "10-12", "99999999999"]
    assert [r["pages"] for r in applied(spark, lambda c: scalars.parse_page_spec(c, F.lit(3)), far)] == [[1, 2, 3], [2, 3], [1, 2, 3], [], []]


def test_page_list(spark):
    assert applied(spark, scalars.clean_page_list, [[3, 1, 3, 0, -2], [0], [], None], "array<int>") == [[3, 1], [], [], None]


def test_names(spark):
    assert applied(spark, scalars.doc_name, ["a/b/C.pdf", "C.pdf", ""]) == ["C.pdf", "C.pdf", ""]
    assert applied(spark, scalars.doc_stem, ["a/b/C.x.PDF", "C"]) == ["c.x", "c"]
    assert applied(spark, scalars.safe_name, ["a/b/c"]) == ["a-b-c"]
    assert applied(spark, scalars.source_path, ["a", "a.pdf", "a.PDF"]) == ["a.pdf", "a.pdf", "a.PDF"]


def test_json(spark):
    given = ['{"a": "x"}', 'text ```json\n{"a": None,}\n``` more', '{"a": "y",}', "broken", "", None]
    got = applied(spark, lambda c: scalars.read_json(c, "a string"), given)
    assert [r and r["a"] for r in got] == ["x", None, "y", None, None, None]
    assert got[1] is not None and got[3] is None


def test_parent_code(spark):
    assert applied(spark, scalars.parent_code, ["1.2.3", "1.2", "1", "", None]) == ["1.2", "1", None, None, None]


def test_toc_rules(spark):
    pages = ["Contents\n1 A", "Inhalt", "a ..... 1\nb ..... 2\nc ..... 3", "a ..... 1\nb ..... 2", "no contents here", None, ""]
    assert applied(spark, rules.is_toc_page, pages) == [True, True, True, False, False, False, False]
    assert applied(spark, rules.has_page_numbers, ["Contents\nA: 1\nB", "A\nB\nC: 1", "", None]) == [True, False, False, False]
    got = applied(spark, rules.parse_toc_lines, ["Contents\n1.2 Two words: 7\n\nPlain"])[0]
    assert [tuple(x) for x in got] == [("1.2", "Two words", 7), (None, "Plain", None)]


def test_title_appears(spark):
    rows = spark.createDataFrame([("A b", "x\na B y"), ("A b", "AB c"), ("A b", "1.2 a b c"), ("", "x"), (None, "x"), ("a", None)], "t string, p string")
    got = [tuple(r[0]) for r in rows.select(rules.title_appears("t", "p")).collect()]
    assert got == [(True, False), (True, True), (True, True), (False, False), (False, False), (False, False)]


def test_clip(spark):
    assert applied(spark, lambda c: rules.clip(c, 6), ["short", "two words", "longerword", "sixsix more", "", None]) == ["short", "two", "longer", "sixsix", "", ""]
