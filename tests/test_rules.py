"""Rules in their cheap forms against the plain ones."""

import random
import re

from pyspark.sql import functions as F

from doctree.functions import rules


def test_squashed_texts_and_titles_as_in_the_plain_form(spark):
    rng = random.Random(3)
    parts = ["1.2 ", "12. ", "3\t", " ", "\n", "\t\x0b\f\r", "Title", "İx", "ΣΑΣ", "ß", "é", "2x", ".", "..... 4\n", ". . . . . 7\n", "contents\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None]
    rows = [(i, rng.choice([x[: rng.randint(0, 8)] if x else x, (x or "")[4:9], rng.choice(parts)]), x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, title string, text string")
    text, title = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))
    old = lambda c: F.translate(F.lower(c), " \t\n\x0b\f\r", "")
    bare = old(F.regexp_replace(text, rules._CODE, ""))
    start = (old(title) != "") & (F.startswith(old(text), old(title)) | F.startswith(bare, old(title)))
    there = (old(title) != "") & F.contains(old(text), old(title))
    toc = text.rlike(rules._HEADER) | (F.size(F.regexp_extract_all(text, F.lit(rules._LEADER_LINE), F.lit(0))) >= 3)
    new = rules.title_appears("title", "text")
    both = df.select(rules.squash(text).alias("a"), old(text).alias("b"), new["at_start"].alias("c"), start.alias("d"), new["appears"].alias("e"), (there | start).alias("f"), rules.is_toc_page("text").alias("g"), toc.alias("h")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f and r.g == r.h for r in both)
    assert sum(r.c for r in both) > 50 and sum(r.e for r in both) > 100 and 20 < sum(r.g for r in both) < len(both) - 20


def test_text_is_squashed_once_and_lines_without_leaders_are_not_tried(spark):
    plan = lambda c: str(spark.createDataFrame([("a", "b")], "title string, text string").select(c.alias("x"))._jdf.queryExecution().optimizedPlan())
    appears = plan(rules.title_appears("title", "text"))
    assert "translate" not in appears and len(re.findall(r"lower\(", appears)) == 3
    assert re.search(r"CASE WHEN \(?Contains", plan(rules.is_toc_page("text")))
