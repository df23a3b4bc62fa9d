"""Document fingerprints: digests of content-defined chunks with their lengths, compared by containment."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .gear import Sizes, digests
from .shared import BLOCK_BYTES, blocks, bounded, buffers

SIZES = Sizes()
_PART = np.dtype([("digest", "<u8"), ("bytes", "<u4")])


def _pack(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distinct digests in order, each with the bytes of all its chunks."""
    kinds, where = np.unique(hashes, return_inverse=True)
    out = np.empty(len(kinds), _PART)
    out["digest"] = kinds
    out["bytes"] = np.bincount(where, lengths, len(kinds))
    return out


def _packed(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> list[np.ndarray]:
    starts, ends, hashes, index = digests(data, at, sizes)
    lengths = ends - starts
    return [_pack(hashes[a:b], lengths[a:b]) for a, b in zip(index[:-1], index[1:])]


def text_form(parts: np.ndarray) -> str:
    return base64.b64encode(parts.tobytes()).decode()


def parts(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _PART)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes that stand in chunks which b has too; 1 for two empty ones, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a["digest"], b["digest"], assume_unique=True, return_indices=True)
    return float(np.minimum(a["bytes"][i], b["bytes"][j]).sum() / a["bytes"].sum())


def fingerprints(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """Adds fingerprint (string) for each whole text; equal texts have equal ones, null and empty an empty one.

    A fingerprint is the base64 form of its sorted (digest, bytes) pairs, 12 bytes each. Rows and other columns
    stay; a column that is called fingerprint is replaced.
    """
    docs = bounded(docs).drop("fingerprint")

    def run(batches):
        for rows, data, at in blocks(batches):
            found = pa.array([text_form(p) for p in _packed(data, at, sizes)], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("fingerprint", T.StringType())]))


def _in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, guest, doc_id, text): ranges of descending doc_id; a guest is the first document of the next range.

    Null ids come last. The bounds come from approximate quantiles and only balance the ranges.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    number = F.lit(len(cuts))
    # The count of bounds above doc_id, among `buckets` numbers.
    if cuts:
        bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
        number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("doc_id"))))
    placed = docs.select("doc_id", "text", number.cast("int").alias("bucket"))
    heads = [tuple(r) for r in placed.groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()]  # a row a bucket
    guests = spark.createDataFrame([(heads[i - 1][0], head) for i, (_, head) in enumerate(heads)], "host int, head long")
    own = placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    visits = placed.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("host").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text")
    return own.unionByName(visits)


def compare_with_next(docs: DataFrame, sizes: Sizes = SIZES, buckets: int | None = None) -> DataFrame:
    """Each document against its edited text and the next one by descending doc_id; see op2_fingerprints.

    The text moves once, into ranges of doc_id that are sorted and streamed, so no task holds more than a few
    megabytes. Documents of equal id are ordered by text, null ids come last (all in one range). A lone
    document is its own next one.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = _in_buckets(docs, buckets)
    moved = moved.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def results(ids: list, texts: list[str]):
        """ids has one less than texts: the last text only is a next one."""
        edited, counts = [], []
        for text, after in zip(texts, texts[1:]):
            n = len(text)
            counts.append(n)
            edited.append(text[: n - n // 2] + after[: n // 2])
        own = _packed(*buffers(pa.array(texts, pa.large_string())), sizes)
        changed = _packed(*buffers(pa.array(edited, pa.large_string())), sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([text_form(x) for x in own[:-1]], pa.string()),
                pa.array([text_form(x) for x in changed], pa.string()),
                pa.array([containment(a, b) for a, b in zip(own, changed)], pa.float64()),
                pa.array([containment(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=[f.split()[0] for f in _RESULT.split(", ")],
        )

    def run(batches):
        ids, texts, size, bucket, done = [], [], 0, None, False
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                for b, guest, i, text in zip(*(rows.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                    if b != bucket:
                        ids, texts, size, bucket, done = [], [], 0, b, False
                    if done:
                        continue
                    texts.append(text)
                    size += len(text)
                    if guest or size > BLOCK_BYTES:
                        if ids:
                            yield results(ids, texts)
                        ids, texts, size = [], texts[-1:], 0
                    if guest:
                        done = True
                    else:
                        ids.append(i)

    return moved.mapInArrow(run, _RESULT)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
