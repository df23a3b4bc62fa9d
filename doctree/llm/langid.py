"""Language identification: averaged embeddings of hashed subwords and a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .quality import held_out
from .shared import LOWER, WORD, Words, blocks, bounded, byte_table, fresh, mix

BITS = 16
SIZE = 16
#: Documents a language that the model is fitted on, at most: those of the smallest hashed doc_id.
MOST_ROWS = 2048
#: Documents of all languages, at most; each language gives its first before any gives its second.
MOST_IN_ALL = 16384
#: Bytes of the model, at most; it has 256 kB a language and is broadcast. More languages are an error, none is left out.
MOST_BYTES = 1 << 30
UNKNOWN = "und"
_LETTER = byte_table(lambda i: 97 <= i <= 122 or i >= 128)


def subwords(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each subword: three and four bytes of a word and its edges, and whole words."""
    data = LOWER[data]
    letter = _LETTER[data]
    codes = np.where(letter, data, np.uint8(32)).astype(np.uint64)
    n = len(codes)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = []
    for size in (3, 4):
        if n < size:
            continue
        m = n - size + 1
        same = text[:m] == text[size - 1 :]
        for i in range(1, size - 1):
            same &= letter[i : m + i]
        begin = np.flatnonzero(same)
        h = np.full(len(begin), size, np.uint64)
        for i in range(size):
            h = h << np.uint64(8) | codes[begin + i]
        found.append((h, text[begin]))
    words = Words(data, at, WORD, lower=False)
    found.append((words.hashes, np.repeat(np.arange(len(at) - 1), words.counts)))
    h = np.concatenate([x for x, _ in found])
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([x for _, x in found])


@dataclass
class Model:
    langs: list[str]
    #: embeddings @ output weights, a row a bucket: the mean of a text's rows are its logits.
    table: np.ndarray
    temperature: float
    #: Scores below it are rejected.
    least: float

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        index, text = subwords(data, at)
        n = len(at) - 1
        counts = np.maximum(np.bincount(text, minlength=n), 1)
        logits = np.stack([np.bincount(text, self.table[index, k], n) / counts for k in range(len(self.langs))], axis=1) if n else np.zeros((0, len(self.langs)))
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 3, rate: float = 0.5, seed: int = 5) -> Model | None:
    """Stochastic gradient descent over (distinct buckets, times, language); every eighth row only calibrates."""
    langs = sorted({x[2] for x in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE))
    out = np.zeros((SIZE, len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    learn = [x for i, x in enumerate(rows) if i % 8 or len(rows) < 64]
    judge = [x for i, x in enumerate(rows) if not i % 8 or len(rows) < 64]
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            index, times, lang = learn[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(index):
                continue
            share = times / times.sum()
            hidden = share @ table[index]
            error = softmax(hidden @ out)
            error[number[lang]] -= 1
            back = out @ error
            out -= lr * np.outer(hidden, error)
            # A step as if every subword had the mean's weight, scaled so that long and short texts move alike.
            table[index] -= lr * np.outer(share * len(index) / max(share.max() * len(index), 1), back)
    logits = table @ out
    held = [(times / times.sum()) @ logits[index] for index, times, _ in judge if len(index)]
    truth = [number[x[2]] for x in judge if len(x[0])]
    temperature, least = 1.0, 0.0
    if held:
        held, truth = np.array(held), np.array(truth)
        grid = 2.0 ** np.arange(-4, 5, 0.5)
        loss = [-np.log(np.maximum(softmax(held / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(held / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        least = float(np.quantile(right, 0.01)) if len(right) else 0.0
    return Model(langs, logits.astype(np.float32), temperature, least)


def _chosen(rows: DataFrame, most_rows: int, most_in_all: int) -> DataFrame:
    """The (doc_id, lang) of rows to learn from, see fit; most_in_all at most.

    Hashes of ids are spread evenly, so those below a limit set by a language's number of ids hold the most_rows smallest,
    and hardly more than four times as many rows are put in order.
    """
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n"))
    share = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    near = rows.join(langs, "lang").filter(share * F.col("_n") <= 4 * most_rows + 64).select("doc_id", "lang").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("_turn", turn).filter(F.col("_turn") <= most_rows).orderBy("_turn", F.xxhash64("doc_id"), "doc_id", "lang").limit(most_in_all)


def fit(docs: DataFrame, most_rows: int = MOST_ROWS, most_in_all: int = MOST_IN_ALL) -> Model | None:
    """A model from the text and non-null lang of docs that are not held out; None if there is nothing to learn.

    At most most_rows documents a language, those of the smallest hashed doc_id, and most_in_all together are used; null
    ids, texts and languages are left out, and of several texts of one doc_id and language the one of the smallest hash
    counts. Subwords are counted on the executors; one task fits. Languages whose model would exceed MOST_BYTES are an error.
    """
    docs = bounded(docs)
    rows = docs.select("doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    chosen = _chosen(rows, most_rows, most_in_all)
    # At most most_in_all pairs of an id and a language.
    texts = docs.select("doc_id", "lang", "text").filter("text is not null").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def sparse(batches):
        for rows, data, at in blocks(batches):
            index, text = subwords(data, at)
            order = np.argsort(text, kind="stable")
            index, cuts = index[order], np.searchsorted(text[order], np.arange(len(at)))
            ids, times = [], []
            for d in range(rows.num_rows):
                kinds, n = np.unique(index[cuts[d] : cuts[d + 1]], return_counts=True)
                ids.append(kinds.astype("<i4").tobytes())
                times.append(n.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(times, pa.binary()), rows.column("lang")], names=["doc_id", "ids", "times", "lang"])

    def learn(batches):
        seen = []
        for batch in batches:
            for ids, times, lang in zip(*(batch.column(c).to_pylist() for c in ("ids", "times", "lang"))):
                seen.append((np.frombuffer(ids, "<i4"), np.frombuffer(times, "<f4").astype(np.float64), lang))
        langs = len({lang for *_, lang in seen})
        if langs * 4 << BITS > MOST_BYTES:
            raise ValueError(f"a model of {langs} languages would exceed {MOST_BYTES} bytes")
        model = train(seen)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.langs]), pa.array([model.table.tobytes()]), pa.array([model.temperature]), pa.array([model.least])], names=["langs", "logits", "temperature", "least"])

    made = texts.mapInArrow(sparse, "doc_id long, ids binary, times binary, lang string").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "lang", "ids")
    row = made.mapInArrow(learn, "langs array<string>, logits binary, temperature double, least double").first()
    if not row:
        return None
    return Model(row["langs"], np.frombuffer(row["logits"], np.float32).reshape(1 << BITS, -1), row["temperature"], row["least"])


def identify(docs: DataFrame, model: Model | None, reject: bool = True) -> DataFrame:
    """Adds lang_pred, score (of the best language, calibrated) and accepted to docs.

    lang_pred is `und` with a score of 0 if text is null or has no letter, or if there is no model; with
    `reject` it is also `und` where the score is below the model's limit (accepted is false there). Rows and
    other columns stay; columns of these three names are replaced.
    """
    docs = bounded(docs).drop("lang_pred", "score", "accepted")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType(docs.schema.fields + added)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    kept = docs.sparkSession.sparkContext.broadcast(model)
    flag = fresh(docs, "_letters")

    def run(batches):
        model = kept.value
        for rows, data, at in blocks(batches):
            p = model.probabilities(data, at)
            known = np.array(rows.column(flag).to_pylist(), bool)
            best = p.argmax(axis=1)
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            fine = known & (score >= model.least)
            langs = [model.langs[k] if (f if reject else o) else UNKNOWN for k, f, o in zip(best, fine, known)]
            rows = rows.drop_columns([flag])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs), pa.array(score), pa.array(fine)], names=[*rows.schema.names, "lang_pred", "score", "accepted"])

    return docs.withColumn(flag, letters).mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model, reject=False)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")
