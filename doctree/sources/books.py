"""Plain documents as paged books: pagination, and a view with headings, covers and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import count_tokens, let


def _page_texts(text: Column, lines_per_page: int) -> Column:

    def by_lines(lines):
        count = F.ceil(F.size(lines) / lines_per_page).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page)), "\n"))

    return F.when(text.contains("\f"), F.split(text, "\f")).otherwise(let(F.split(text, "\n"), by_lines))


def paginate(docs: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Pages of documents: at form feeds if there are any, else every lines_per_page lines. Null text is one empty page."""
    pages = _page_texts(F.coalesce("text", F.lit("")), lines_per_page)
    return with_tokens(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1))


def with_tokens(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, token_length); null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return pages.select("doc_id", F.col("page").cast("int").alias("page"), text.alias("text"), count_tokens(text).alias("token_length"))


def books(docs: DataFrame, lines_per_page: int = 10) -> DataFrame:
    """Pages of documents dressed as books.

    Each body page opens with a heading: a code (three pages a chapter) and the first four words of the page.
    Books of three pages or more also get a cover and a contents page. By doc_id modulo 5: 1 has no printed
    page numbers, 2 no contents page, 3 lacks the heading of each third page, 4 misprints the title of each
    second one.
    """
    body = _page_texts(F.coalesce("text", F.lit("")), lines_per_page)
    chapter = lambda i: (F.floor(i / 3) + 1).cast("string")
    code = lambda i: F.when(i % 3 == 0, chapter(i)).otherwise(F.concat(chapter(i), F.lit("."), (i % 3 + 1).cast("string")))
    # Four words and what may stand before and behind them; the rest of the page stays in one piece.
    title = lambda t: F.array_join(F.slice(F.filter(F.split(t, r"\s+", 6), lambda w: w != ""), 1, 4), " ")
    kind = F.coalesce(F.pmod(F.col("doc_id"), F.lit(5)), F.lit(0))
    paged = docs.select(F.col("doc_id").cast("string").alias("doc_id"), kind.alias("kind"), body.alias("body"))
    paged = paged.withColumn("titles", F.transform("body", title))
    headed = F.transform(F.arrays_zip("body", "titles"), lambda x, i: F.when((F.col("kind") == 3) & (i % 3 == 2), x["body"]).otherwise(F.concat(code(i), F.lit(" "), x["titles"], F.lit("\n"), x["body"])))
    entry = lambda t, i: F.concat(
        code(i), F.lit(" "), t, F.when((F.col("kind") == 4) & (i % 3 == 1), " zz").otherwise(""), F.when(F.col("kind") == 1, "").otherwise(F.concat(F.lit(" ......... "), (i + 1).cast("string")))
    )
    contents = F.concat(F.lit("Contents\n"), F.array_join(F.transform("titles", entry), "\n"))
    front = F.when((F.size("body") >= 3) & (F.col("kind") != 2), F.array(F.concat(F.lit("Document "), F.col("doc_id")), contents)).otherwise(F.array().cast("array<string>"))
    out = paged.select("doc_id", F.concat(front, headed).alias("all"))
    return with_tokens(out.select("doc_id", F.posexplode("all").alias("page", "text")).withColumn("page", F.col("page") + 1))
