"""Lookups over a catalog of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import doc_stem, pages_of_ranges, parse_page_ranges


def find_documents(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests (request_id, doc_name, ..) with doc_id and error: by exact name, else by lower-case stem, the first by path.

    Both keys of a catalog entry meet the request in one equi-join.
    """
    exact = catalog.select(F.col("doc_name").alias("_key"), F.lit(0).alias("_by"), "doc_id", "path")
    stems = catalog.select(doc_stem("doc_name").alias("_key"), F.lit(1).alias("_by"), "doc_id", "path")
    asked = requests.select("request_id", F.explode(F.array(F.struct(F.col("doc_name").alias("key"), F.lit(0).alias("by")), F.struct(doc_stem("doc_name").alias("key"), F.lit(1).alias("by")))).alias("_q"))
    asked = asked.select("request_id", F.col("_q.key").alias("_key"), F.col("_q.by").alias("_by"))
    hits = asked.join(exact.unionByName(stems), ["_key", "_by"])
    best = hits.groupBy("request_id").agg(F.min_by("doc_id", F.struct("_by", "path", "doc_id")).alias("doc_id"))
    out = requests.drop("doc_id").join(best, "request_id", "left")
    return out.withColumn("error", F.when(F.col("doc_id").isNull(), F.concat(F.lit("unknown document: "), F.coalesce("doc_name", F.lit("")))))


def page_texts(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, content) of wanted (request_id, doc_id, ord, page): existing pages as (page, text), by ord.

    Distinct pages are fetched once, however many requests name them.
    """
    fetched = pages.select("doc_id", "page", "text").join(wanted.select("doc_id", "page").distinct(), ["doc_id", "page"])
    parts = wanted.join(fetched, ["doc_id", "page"]).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ord", "page", "text"))).alias("_p"))
    return parts.select("request_id", F.transform("_p", lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text"))).alias("content"))


def get_page_content(requests: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, doc_id, content, error) of requests (request_id, doc_id, pages).

    pages is a specification such as 5-7. Pages that the document lacks vanish; an unknown document and a bad
    specification are errors, and then content is null. Ranges end at the document's last page before they become rows.
    """
    known = catalog.select("doc_id", F.lit(True).alias("_known"))
    asked = requests.select("request_id", "doc_id", parse_page_ranges("pages").alias("_s")).join(known, "doc_id", "left")
    error = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown document: "), F.coalesce("doc_id", F.lit("")))).otherwise(F.col("_s.error"))
    asked = asked.withColumn("error", error)
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    wanted = asked.filter("error is null").select("request_id", "doc_id", "_s.ranges").join(ends, "doc_id")
    wanted = wanted.select("request_id", "doc_id", F.posexplode(pages_of_ranges(F.col("ranges"), F.col("_last"))).alias("ord", "page"))
    none = F.array().cast("array<struct<page:int,text:string>>")
    return asked.join(page_texts(wanted, pages), "request_id", "left").select("request_id", "doc_id", F.when(F.col("error").isNull(), F.coalesce("content", none)).alias("content"), "error")
