"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import NOT_SPACE, Words, blocks, bounded, mix, range_hashes

BITS = 18
#: Labelled rows that the model is fitted on, at most: those of the smallest hashed doc_id.
MOST_ROWS = 8192
THRESHOLD = 0.7
#: Byte classes of word shapes: A upper case, a lower case and letters beyond ASCII, 0 digits, all else itself.
_SHAPES = np.array([65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256)], np.uint8)


def _shape_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hashes of word shapes with runs of one class taken as one: `The` is Aa, `THE!!` is A!."""
    kinds = _SHAPES[data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return range_hashes(kinds[keep].astype(np.uint64) + np.uint64(1), before[words.starts], before[words.ends])


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices of all texts, the number of words of each text, and the text of each feature.

    Views: lower-cased words, pairs of them, shapes, pairs and triples of shapes, and pairs of equal words.
    """
    words = Words(data, at, NOT_SPACE)
    n = len(words.starts)
    text = np.repeat(np.arange(len(at) - 1), words.counts)
    shapes = _shape_hashes(data, words)
    follows = np.flatnonzero(text[1:] == text[:-1]) + 1 if n > 1 else np.zeros(0, np.int64)
    third = follows[text[follows - 2] == text[follows]] if n > 2 else np.zeros(0, np.int64)
    third = third[third >= 2]
    equal = follows[words.hashes[follows] == words.hashes[follows - 1]]
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    hashed = [
        (words.hashes, text),
        (words.hashes[follows - 1] * k[0] + words.hashes[follows] * k[1] + k[2], text[follows]),
        (shapes * k[1], text),
        (shapes[follows - 1] * k[1] + shapes[follows] * k[2], text[follows]),
        (shapes[third - 2] * k[2] + shapes[third - 1] * k[0] + shapes[third] * k[1], text[third]),
        (np.full(len(equal), 7, np.uint64), text[equal]),
    ]
    index = np.concatenate([mix(h) >> np.uint64(64 - BITS) for h, _ in hashed]).astype(np.int64)
    return index, words.counts, np.concatenate([t for _, t in hashed])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        index, counts, text = features(data, at)
        sums = np.bincount(text, self.weights[index], len(counts))
        return 1 / (1 + np.exp(-np.clip(self.bias + _SCALE * sums / np.maximum(counts, 1), -50, 50)))


#: A feature's value is this times its share of the words of its text.
_SCALE = 8.0


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal over (distinct indices, values, label), in the order given. Without rows every score is 0.5."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for index, values, label in rows:
            index, values = np.append(index, size), np.append(values, 1.0)
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -50, 50)))
            g = (p - label) * values
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(doc_id):
    """True for the quarter of rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model of labels (doc_id, a 0/1 column), fitted on at most most_rows labelled rows that are not held out.

    Null ids and labels are left out; of several labels of one doc_id the largest counts. The choice of rows
    depends on ids alone; of several texts of one doc_id the one of the smallest hash counts. Features are made on the
    executors; one task fits, over at most most_rows rows.
    """
    docs = bounded(docs)
    some = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    some = some.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # At most most_rows pairs of numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def sparse(batches):
        for rows, data, at in blocks(batches):
            index, counts, text = features(data, at)
            order = np.argsort(text, kind="stable")
            index, cuts = index[order], np.searchsorted(text[order], np.arange(len(at)))
            ids, values = [], []
            for d in range(rows.num_rows):
                kinds, times = np.unique(index[cuts[d] : cuts[d + 1]], return_counts=True)
                ids.append(kinds.astype("<i4").tobytes())
                values.append((_SCALE * times / max(counts[d], 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(values, pa.binary()), rows.column("label")], names=["doc_id", "ids", "values", "label"])

    def learn(batches):
        seen = []
        for batch in batches:
            for ids, values, y in zip(*(batch.column(c).to_pylist() for c in ("ids", "values", "label"))):
                seen.append((np.frombuffer(ids, "<i4"), np.frombuffer(values, "<f4"), y))
        model = train(seen)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    made = chosen.mapInArrow(sparse, "doc_id long, ids binary, values binary, label int").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "ids")
    row = made.mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"]) if row else train([])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1, higher: a label of 1 is likelier) for each whole text.

    Null and empty texts have no words and get the model's bias. Rows and other columns stay; a column that is
    called score is replaced.
    """
    docs = bounded(docs).drop("score")
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, data, at in blocks(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kept.value.scores(data, at))], names=[*rows.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("score", T.DoubleType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
