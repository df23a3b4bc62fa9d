"""Batches of lookups over stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clean_page_list, tag_page
from ..operators import catalog as lookups
from ..operators import requests as ask
from ..operators import tree


def list_documents(index_docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, doc_name, doc_description, page_count); the count is the largest end of the tree."""
    out = index_docs.select("doc_id", "doc_name", F.coalesce("doc_description", F.lit("")).alias("doc_description"))
    return out.join(tree.max_end_index(nodes), "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def get_documents(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, doc_id, doc_name, doc_description, page_count, status, error) for requests (request_id, doc_id)."""
    known = catalog.select("doc_id", "doc_name", "doc_description", "page_count", F.lit(True).alias("_known"))
    out = requests.select("request_id", "doc_id").join(known, "doc_id", "left")
    unknown = F.col("_known").isNull()
    return out.select("request_id", "doc_id", "doc_name", "doc_description", "page_count", F.when(~unknown, "completed").alias("status"), F.when(unknown, F.concat(F.lit("unknown document: "), F.coalesce("doc_id", F.lit("")))).alias("error"))


def get_structures(requests: DataFrame, catalog: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, doc_id, structure_json, error) for requests (request_id, doc_name): trees without text."""
    found = lookups.find_documents(requests, catalog)
    wanted = nodes.join(found.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi")
    shown = found.join(tree.export_tree(tree.strip_text(wanted)), "doc_id", "left")
    return shown.select("request_id", "doc_id", F.when(F.col("error").isNull(), F.coalesce("structure_json", F.lit("[]"))).alias("structure_json"), "error")


def get_page_content(requests: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """C11: page text for many requests."""
    return lookups.get_page_content(requests, catalog, pages)


def answer_requests(requests: DataFrame, catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """(request_id, doc_id, pages, prompt, error) for requests (request_id, doc_name, page_indices, question).

    The prompt holds the tagged text of the pages that exist, in the order asked for. An unknown document and
    a list without a valid page are errors.
    """
    found = lookups.find_documents(requests, catalog).withColumn("_pages", clean_page_list("page_indices"))
    found = found.withColumn("error", F.coalesce("error", F.when(F.coalesce(F.size("_pages"), F.lit(0)) <= 0, "no valid page")))
    wanted = found.filter("error is null").select("request_id", "doc_id", F.posexplode("_pages").alias("ord", "page"))
    texts = lookups.page_texts(wanted, pages)
    joined = found.join(texts, "request_id", "left")
    joined = joined.withColumn("error", F.coalesce("error", F.when(F.col("content").isNull(), "no valid page")))
    body = F.array_join(F.transform("content", lambda x: tag_page(x["text"], x["page"])), "")
    prompt = F.when(F.col("error").isNull(), ask._filled(ask.PROMPTS["answer"]))
    return joined.withColumn("text", body).select("request_id", "doc_id", F.when(F.col("error").isNull(), F.col("content.page")).alias("pages"), prompt.alias("prompt"), "error")
