"""Page text where operators look for it: a plain table, or one stored in buckets so that text stays where it is."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import delete, shared_dir
from .membership import likely_members

#: Pages that are gathered into one row. A document of any length is many such blocks.
PAGE_BLOCK = 64


def block_of(page: Column) -> Column:
    return F.floor(page / PAGE_BLOCK).cast("int")


def gathered(pages: DataFrame) -> DataFrame:
    """(doc_id, _block, _pages): the pages of each block in order, as structs of page, text and token_length."""
    one = F.struct("page", "text", "token_length") if "token_length" in pages.columns else F.struct("page", "text")
    return pages.select("doc_id", block_of(F.col("page")).alias("_block"), one.alias("_p")).groupBy("doc_id", "_block").agg(F.sort_array(F.collect_list("_p")).alias("_pages"))


class Pages:
    """Pages (doc_id, page, text, token_length), flat and perhaps in stored blocks."""

    def __init__(self, flat: DataFrame, blocks: DataFrame | None = None):
        self.flat, self._blocks = flat, blocks

    @staticmethod
    def of(pages: DataFrame | Pages) -> Pages:
        return pages if isinstance(pages, Pages) else Pages(pages)

    @property
    def blocks(self) -> DataFrame:
        return gathered(self.flat) if self._blocks is None else self._blocks

    def only(self, docs: DataFrame, n: int) -> Pages:
        """The pages of n documents (doc_id), and perhaps of few others: a bitmap drops the rest, and no text is shuffled."""
        if self._blocks is None:
            return Pages(self.flat.join(docs.select("doc_id"), "doc_id", "left_semi"))
        blocks = likely_members(self._blocks, docs, ["doc_id"], n)
        return Pages(_flat(blocks), blocks)

    def meet(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, _block, ..) with the _pages of their block, null if there is none. Rows go to the blocks."""
        return self.blocks.join(rows.hint("shuffle_hash"), ["doc_id", "_block"], "right")

    def text_of(self, rows: DataFrame, page: str) -> DataFrame:
        """rows (doc_id, page, ..) with text, the text of the page that the column names, null if there is none."""
        if self._blocks is None:
            text = self.flat.select("doc_id", F.col("page").alias(page), "text")
            return rows.join(text, ["doc_id", page], "left")
        found = F.get(F.filter("_pages", lambda x: x["page"] == F.col(page)), F.lit(0))
        return self.meet(rows.withColumn("_block", block_of(F.col(page)))).withColumn("text", found["text"]).select(*rows.columns, "text")

    def in_ranges(self, ranges: DataFrame, first: str, last: str) -> DataFrame:
        """ranges (doc_id, first, last, ..) with page, text and token_length, a row for each page from first to last that there is."""
        if self._blocks is None:
            some = ranges.filter(F.col(first) <= F.col(last)).withColumn("page", F.explode(F.sequence(F.col(first), F.col(last))))
            return some.join(self.flat, ["doc_id", "page"])
        some = ranges.filter(F.col(first) <= F.col(last))
        parts = self.meet(some.withColumn("_block", F.explode(F.sequence(block_of(F.col(first)), block_of(F.col(last))))))
        return parts.select(*ranges.columns, F.explode("_pages").alias("_p")).select(*ranges.columns, "_p.*").filter(F.col("page").between(F.col(first), F.col(last)))


def _flat(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", F.explode("_pages").alias("_p")).select("doc_id", "_p.page", "_p.text", "_p.token_length")


class stored_pages:
    """with stored_pages(pages) as store: pages in blocks, in a table bucketed and sorted by (doc_id, block), deleted at the end.

    Text is shuffled once, to write it. What joins it by page or by range afterwards is shuffled to the buckets, and
    a long document is spread over as many as it has blocks.
    """

    def __init__(self, pages: DataFrame, buckets: int | None = None):
        self.spark, self.pages = pages.sparkSession, pages
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = uuid.uuid4().hex
        self.table, self.path = f"doctree_pages_{name}", f"{shared_dir(self.spark)}/{name}-pages"

    def __enter__(self) -> Pages:
        columns = {c: F.lit(0) for c in ("token_length",) if c not in self.pages.columns}
        made = gathered(self.pages.withColumns(columns) if columns else self.pages)
        made.write.bucketBy(self.buckets, "doc_id", "_block").sortBy("doc_id", "_block").option("path", self.path).saveAsTable(self.table)
        blocks = self.spark.table(self.table)
        return Pages(_flat(blocks), blocks)

    def __exit__(self, *error) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)
