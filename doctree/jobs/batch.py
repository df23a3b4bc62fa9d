"""Batches of documents: built again only where something has changed, and whole even if single documents cannot be built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.membership import likely_members
from ..operators.requests import Answers
from ..sources.scratch import cut, keep, scope
from ..sources.store import Store, changed, digests
from .build import Knobs, build_index

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
#: Parts that a set of documents is divided into when its job fails.
PARTS = 8


@dataclass
class Isolated:
    """Results of all sets of documents whose job ran, and a row (doc_id, error) for each document whose job fails."""

    results: list
    failures: DataFrame


def isolate(pages: DataFrame, job: Callable[[DataFrame], object], most: int = 100, parts: int = PARTS) -> Isolated:
    """Runs job on pages; if it fails, on the documents in parts, and so on down to the single ones that it fails on.

    job takes the pages of some documents and must not leave work to be done later. Documents are divided by a hash of doc_id, which is
    all of the rows that is read to do so. While nothing fails this is one run; a failing document costs about as
    many rounds as the logarithm of the number of documents, each on a fraction of the one before. More than `most` failing
    documents are a failure of the whole, and so is one before any document is read.
    """
    spark = pages.sparkSession
    key = F.xxhash64(F.col("doc_id").cast("string"))
    with scope(spark):
        ids = cut(pages.select("doc_id").distinct().withColumn("_key", key))
        inside = lambda column, low, high: column.between(F.lit(low), F.lit(high))
        todo, results, failures = [(_LOW, _HIGH)], [], []
        while todo:
            low, high = todo.pop()
            here = ids.filter(inside(F.col("_key"), low, high)).select("doc_id").limit(2).collect()
            if not here and (low, high) != (_LOW, _HIGH):
                continue
            try:
                results.append(job(pages if (low, high) == (_LOW, _HIGH) else pages.filter(inside(key, low, high))))
            except Exception as error:
                if not here:
                    raise
                if len(here) == 1:
                    failures.append((here[0]["doc_id"], f"{type(error).__name__}: {error}"[:1000]))
                    if len(failures) > most:
                        raise
                    continue
                # Halfway documents of equal hashes, which cannot be told apart, would never end.
                if low == high:
                    raise
                step = -(-(high - low + 1) // parts)
                todo += [(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
    kind = pages.schema["doc_id"].dataType.simpleString()
    return Isolated(results, spark.createDataFrame(failures, f"doc_id {kind}, error string"))


def index_batch(pages: DataFrame, names: DataFrame | None = None, knobs: Knobs = Knobs(), answers: Answers | None = None, most: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index_docs, nodes, failures): C7 for all documents that can be built; failures has (doc_id, error) of the others. See `isolate`."""
    done = isolate(pages, lambda some: build_index(some, names, knobs, answers), most)
    results = done.results or [build_index(pages.limit(0), names, knobs)]
    index, nodes = (reduce(DataFrame.unionByName, frames) for frames in zip(*results))
    return index, nodes, done.failures


def update(store: Store, pages: DataFrame, names: DataFrame | None = None, knobs: Knobs = Knobs(), answers: Answers | None = None, told: DataFrame | None = None, most: int = 100) -> DataFrame:
    """Builds the documents of pages that are new to the store, have other pages, or have other responses, and puts them there.

    told (doc_id, request_id, response) are the responses that answers holds, by document. Returns (doc_id, status, error) of what was to
    be built, with status built or failed; a document that failed keeps its old entry and is tried again next time.
    """
    with scope(pages.sparkSession):
        found = cut(digests(pages, told))
        new = cut(changed(found, store.read("catalog")))
        # Pages of all others are not read any further; a bitmap drops most of them before text is shuffled. Where all are new, none is.
        n, some = new.count(), pages.filter("doc_id is not null")
        if n < found.count():
            some = likely_members(some, new.select("doc_id"), ["doc_id"], n).join(new.select("doc_id"), "doc_id", "left_semi")
        index, nodes, failures = index_batch(some, names, knobs, answers, most)
        counts = some.groupBy("doc_id").agg(F.max("page").alias("page_count"))
        entries = index.join(new, "doc_id").join(counts, "doc_id", "left").withColumn("type", F.lit("pdf"))
        store.upsert(entries, nodes)
        report = new.select("doc_id").join(failures, "doc_id", "left")
        status = F.when(F.col("error").isNull(), "built").otherwise("failed")
        rows = report.select("doc_id", status.alias("status"), "error")
        return keep(rows)
