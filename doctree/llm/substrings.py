"""Substring deduplication: content-defined chunks of all texts, cut by a gear rolling hash; chunks of equal digests are kept once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .gear import Sizes, chunk
from .shared import _BASE, _BYTE, _WORD_BASE, blocks, bounded, cut, fresh, pieces_of, range_hashes, set_aside

#: Chunks are small against a passage, so that one loses little of it before its chunks fall into step and after they leave it.
SIZES = Sizes(least=16, normal=24, most=64)
#: Shorter runs of chunks in common, in code points, stay: a phrase in common is no passage.
LEAST_RUN = 100


def _cut_up(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each text's first) of all chunks, in bytes; no chunk ends inside a code point."""
    ends, index = chunk(data, at, sizes)
    if (data & 0x80).any():
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        ends = places[np.searchsorted(places, ends)]
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1]
    return starts, ends, index


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each chunk: two hashes of different bases."""
    values = _BYTE[data]
    check = range_hashes(values, starts, ends, _WORD_BASE) >> np.uint64(32)
    return range_hashes(values, starts, ends, _BASE).view(np.int64), check.astype(np.uint32).view(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def chunks(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """(digest, check, doc_id, text_key, i, start, end): the chunks of every whole text, numbered, places in code points.

    text_key tells texts of one doc_id apart. Null and empty texts have none.
    """

    def run(batches):
        for rows, data, at in blocks(batches):
            starts, ends, index = _cut_up(data, at, sizes)
            if not len(ends):
                continue
            digest, check = _digests(data, starts, ends)
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            counts = np.diff(index)
            text = np.repeat(np.arange(rows.num_rows), counts)
            first = np.repeat(points[at[:-1]], counts)
            row = pa.array(text)
            number = np.arange(len(ends)) - index[text]
            places = [pa.array(x.astype(np.int32)) for x in (number, points[starts] - first, points[ends] - first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest), pa.array(check), rows.column("doc_id").take(row), rows.column("text_key").take(row), *places],
                names=["digest", "check", "doc_id", "text_key", "i", "start", "end"],
            )

    return _keyed(docs).mapInArrow(run, "digest long, check int, doc_id long, text_key long, i int, start int, end int")


def _counts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(digest, check, n) of the chunks of each block of texts."""

    def run(batches):
        for _, data, at in blocks(batches):
            starts, ends, _ = _cut_up(data, at, sizes)
            digest, check = _digests(data, starts, ends)
            order = np.lexsort((check, digest))
            digest, check = digest[order], check[order]
            new = np.ones(len(digest), bool)
            new[1:] = (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
            places = np.flatnonzero(new)
            n = np.diff(np.append(places, len(digest))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digest[places]), pa.array(check[places]), pa.array(n)], names=["digest", "check", "n"])

    return bounded(docs).select("text").mapInArrow(run, "digest long, check int, n long")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "doc_id long, text_key long, repeated array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>, first_docs array<bigint>"


def _runs(row: np.ndarray, i: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the runs of neighbouring chunks that have `least` code points; chunks are sorted by row and i."""
    new = np.ones(len(i), bool)
    new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(i)) - 1 if len(i) else low
    fine = end[high] - start[low] >= least
    return low[fine], high[fine]


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n rows of the values that belong to it; row is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _fold(least: int):
    """(doc_id, text_key, at), at the repeated chunks of a document in order, to what `repeats` returns."""

    def run(batches):
        for batch in batches:
            lists = batch.column("at")
            at, n = lists.flatten(), batch.num_rows
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            i, start, end = (at.field(c).to_numpy() for c in ("i", "start", "end"))
            later = at.field("later").to_numpy(zero_copy_only=False)
            low, high = _runs(row, i, start, end, least)
            spans = lambda low, high: pa.StructArray.from_arrays([pa.array(start[low]), pa.array(end[high])], fields=list(_SPANS.value_type))
            some = np.flatnonzero(later)
            first, last = _runs(row[some], i[some], start[some], end[some], least)
            # The documents in which the chunks of removed runs stand first, each once.
            inside = np.zeros(len(some) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, last + 1, -1)
            cut_out = some[np.cumsum(inside)[:-1] > 0]
            of, ids = at.field("of"), batch.column("doc_id")
            known, own = ~of.is_null().to_numpy(zero_copy_only=False), ~ids.is_null().to_numpy(zero_copy_only=False)
            of, ids = of.fill_null(0).to_numpy(), ids.fill_null(0).to_numpy()
            other = cut_out[(known[cut_out] != own[row[cut_out]]) | (of[cut_out] != ids[row[cut_out]])]
            names = np.unique(np.stack([row[other], known[other], of[other]], axis=1), axis=0)
            docs = _lists(names[:, 0], n, pa.array(names[:, 2], pa.int64(), mask=names[:, 1] == 0))
            columns = [_lists(row[low], n, spans(low, high)), _lists(row[some[first]], n, spans(some[first], some[last])), docs]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", "repeated", "removed", "first_docs"])
            yield out.filter(pa.array(np.bincount(row[low], minlength=n) > 0))

    return run


def repeats(docs: DataFrame, least_run: int = LEAST_RUN, sizes: Sizes = SIZES) -> DataFrame:
    """(doc_id, text_key, repeated, removed, first_docs) of each document with repeated passages.

    A chunk repeats if its digest stands elsewhere too, in any text or again in the same one. repeated: the runs of
    neighbouring repeated chunks of `least_run` code points or more. removed: such runs of chunks that are not the
    first of their digest, by (doc_id, text_key, start), null ids first. first_docs: the other documents in which
    the removed chunks stand first. Equal rows (same id, same text) are one document. Null and empty texts repeat nothing.

    A passage in common falls into the same chunks in all texts but for about a chunk at its begin and end,
    however far it has been shifted. Digests are counted before they are shuffled; places are shuffled in a
    second pass and meet the digests that repeat in a join, whose hot keys Spark splits.
    """
    counted = _counts(docs, sizes).groupBy("digest", "check").agg(F.sum("n").alias("n")).filter("n > 1").select("digest", "check")
    again = cut(chunks(docs, sizes).join(counted, ["digest", "check"]))
    place = F.struct("doc_id", "text_key", "start")
    first = again.groupBy("digest", "check").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    found = again.join(first.select("digest", "check", "first"), ["digest", "check"])
    later = ~place.eqNullSafe(F.col("first"))
    each = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("i", "start", "end", later.alias("later"), F.col("first.doc_id").alias("of"))).alias("at"))
    return each.withColumn("at", F.sort_array("at")).mapInArrow(_fold(least_run), _FOUND)


def annotate(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated, removed and first_docs of `repeats`; empty arrays where nothing repeats."""
    added = ("repeated", "removed", "first_docs")
    docs = docs.drop(*added)
    i, k = fresh(docs, "_id"), fresh(docs, "_key")
    found = repeats(docs.select("doc_id", "text"), **how).withColumnsRenamed({"doc_id": i, "text_key": k})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k))
    out = docs.join(found, same, "left")
    return out.select(*docs.columns, *[F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in added])


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """docs with later occurrences of repeated passages cut out of text; columns stay, null texts too."""
    docs, restored = set_aside(docs, "repeated", "removed", "first_docs")
    marked = annotate(docs, **how)
    starts = F.concat(F.array(F.lit(0)), F.col("removed.end"))
    ends = F.concat(F.col("removed.start"), F.array(F.length("text")))
    kept = pieces_of(F.col("text"), starts, ends)
    return restored(marked.withColumn("text", F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its repeated and removed code points, the removed spans and where they stand first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeats(docs)
    narrow = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    total = lambda spans: F.coalesce(F.aggregate(spans, F.lit(0), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0)).cast("long")
    out = narrow.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("text_key")), "left")
    return out.select(
        "doc_id",
        "n_chars",
        total("repeated").alias("n_repeated"),
        total("removed").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias("removed_spans"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )
