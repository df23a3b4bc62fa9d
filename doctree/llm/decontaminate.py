"""Benchmark decontamination: word windows of training texts looked up in a broadcast set of benchmark n-grams."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.membership import parted_by_members
from .shared import WORD, Tables, Words, blocks, bounded, char_offsets, cut, fresh, mix, pieces_of, range_hashes, set_aside

SIZE = 10
#: Benchmark text behind one broadcast set, about. A larger benchmark is dealt over several sets, and texts are scanned with each.
PART_BYTES = 16 << 20

_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class _Set:
    """The windows of one length: sorted hashes, one for each distinct window, its words' place, and the items that have it."""

    def __init__(self, length: int, hashes: np.ndarray, second: np.ndarray, places: np.ndarray, items: np.ndarray):
        # Windows are equal if two hashes are; what a text has is compared by its words besides.
        order = np.lexsort((items, second, hashes))
        hashes, second, places, items = (x[order] for x in (hashes, second, places, items))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
        self.length, self.hashes, self.places, self.items = length, hashes[new], places[new], items
        self.first = np.append(np.flatnonzero(new), len(hashes))


class _Index:
    """Sets of the windows of items, with the items' normalised words once: 20 bytes a word and its text."""

    def __init__(self, items: pa.Array, texts: pa.Array, size: int):
        self.items = items.to_pylist()
        words_of, lengths_of, found, before, row = [], [], {}, 0, 0
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for rows, data, at in blocks([batch]):
            words = Words(data, at, WORD)
            words_of.append(words.joined(0, len(words.starts)))
            lengths_of.append(words.ends - words.starts)
            for length in np.unique(np.minimum(words.counts, size)).tolist():
                begin, hashes = words.windows(length) if length else (np.zeros(0, np.int64), None)
                if not len(begin):
                    continue
                item = np.searchsorted(words.first, begin, "right") - 1
                own = (words.counts[item] >= size) if length == size else (words.counts[item] == length)
                second = range_hashes(mix(words.hashes), begin, begin + length)
                found.setdefault(length, []).append((hashes[own], second[own], (begin[own] + before).astype(np.int32), (item[own] + row).astype(np.int32)))
            before, row = before + len(words.starts), row + rows.num_rows
        self.text = b" ".join(x for x in words_of if x)
        lengths = np.concatenate(lengths_of) if lengths_of else np.zeros(0, np.int64)
        self.ends = (np.cumsum(lengths + 1) - 1).astype(np.int32)
        self.lengths = lengths.astype(np.int32)
        self.sets = [_Set(length, *(np.concatenate(x) for x in zip(*parts))) for length, parts in sorted(found.items())]

    def window(self, place: int, length: int) -> bytes:
        return self.text[self.ends[place] - self.lengths[place] : self.ends[place + length - 1]]

    def hits(self, words: Words) -> list[tuple[int, int, np.ndarray]]:
        """(first word, length, items) of each window that occurs, checked by its words."""
        found = []
        for known in self.sets:
            begin, hashes = words.windows(known.length)
            if not len(begin):
                continue
            at = np.minimum(np.searchsorted(known.hashes, hashes), len(known.hashes) - 1)
            for i in np.flatnonzero(known.hashes[at] == hashes):
                k, own = int(at[i]), words.joined(begin[i], begin[i] + known.length)
                while k < len(known.hashes) and known.hashes[k] == hashes[i]:
                    if self.window(known.places[k], known.length) == own:
                        found.append((int(begin[i]), known.length, known.items[known.first[k] : known.first[k + 1]]))
                        break
                    k += 1
        return found

    def hits_by_text(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
        """For each text with hits the windows, from its own first word on, and the names of the items."""
        found: dict[int, tuple[list, list]] = {}
        for begin, length, items in self.hits(words):
            d = int(np.searchsorted(words.first, begin, "right")) - 1
            windows, some = found.setdefault(d, ([], []))
            windows.append((begin - int(words.first[d]), length))
            some.append(items)
        names = lambda some: [self.items[i] for i in np.unique(np.concatenate(some)).tolist() if self.items[i] is not None]
        return {d: (windows, names(some)) for d, (windows, some) in found.items()}


def _columns(words: Words, data: np.ndarray, at: np.ndarray, found: dict[int, tuple[list[tuple[int, int]], list[str]]]) -> list[pa.Array]:
    """The columns of _HITS for a block of texts and what was found in it."""
    n = len(words.counts)
    n_hit, items, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
    for d, (windows, names) in found.items():
        low = int(words.first[d])
        step = np.zeros(int(words.counts[d]) + 1, np.int64)
        begin, length = np.array(windows).T
        np.add.at(step, begin, 1)
        np.add.at(step, begin + length, -1)
        covered = np.cumsum(step)[:-1] > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1) + low, np.flatnonzero(edge == -1) + low - 1
        own = data[at[d] : at[d + 1]]
        starts, ends = char_offsets(own, words.starts[first] - at[d]), char_offsets(own, words.ends[last] - at[d])
        n_hit[d], items[d] = covered.sum(), sorted(set(names))
        spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]
    return [pa.array(x, f.type) for x, f in zip((words.counts, n_hit, items, spans), _ARROW)]


def _with_hits(batches, found_in):
    for rows, data, at in blocks(batches):
        words = Words(data, at, WORD)
        yield rows, _columns(words, data, at, found_in(rows, words))


def _indexes(benchmark: DataFrame, size: int, part_bytes: int) -> DataFrame:
    """(part, index): pickled indexes of the parts of a benchmark, each built by one task from about part_bytes of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        index = _Index(table.column("item").combine_chunks(), table.column("text").combine_chunks(), size)
        return pa.table({"part": table.column("part").slice(0, 1), "index": pa.array([pickle.dumps(index)], pa.binary())})

    return items.groupBy("part").applyInArrow(build, "part int, index binary")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds n_words, n_hit, hit_items (sorted strings) and hit_spans (code points) to docs.

    docs needs a text column, benchmark item_id and text; other columns pass through, and a column of docs
    that is named like one of the four is replaced. Words are runs of digits, letters and code points over
    127, with A-Z lowered. An item's windows are its runs of `size` words, or all its words if it has fewer.
    Null and empty texts have no words and no hits; empty items and an empty benchmark hit nothing; repeated
    rows stay, each with its own result; items of a null item_id hit like others, but have no name in hit_items.

    The hash set of a benchmark of at most `part_bytes` bytes of text is broadcast, about five times as large as that
    text. A larger benchmark makes several such sets: texts are scanned with one after the other, what they
    hit is kept by the digest of the text, and joined back once. A bitmap of those digests, of a fixed size at most, keeps
    texts without a hit out of that join: they are not shuffled.
    """
    spark = docs.sparkSession
    docs = bounded(docs).drop(*[f.name for f in _HITS])
    schema = T.StructType(docs.schema.fields + _HITS.fields)
    names = [*docs.columns, *_ARROW.names]
    with Tables(spark) as tables:
        made = tables.cut(_indexes(benchmark.select("item_id", "text"), size, part_bytes))
        parts = sorted(r[0] for r in made.select("part").collect())  # a number for each part of the benchmark
        load = lambda part: spark.sparkContext.broadcast(pickle.loads(made.filter(F.col("part") == part).first()["index"]))
        if len(parts) > 1:
            return _scan_parts(docs, parts, load, tables, names, schema)
        index = load(parts[0]) if parts else spark.sparkContext.broadcast(_Index(pa.array([], pa.string()), pa.array([], pa.string()), size))

    def run(batches):
        for rows, added in _with_hits(batches, lambda rows, words: index.value.hits_by_text(words)):
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=names)

    return docs.mapInArrow(run, schema)


def _scan_parts(docs: DataFrame, parts: list[int], load, tables: Tables, names: list[str], schema: T.StructType) -> DataFrame:
    """docs with what they hit in any part of the benchmark. load broadcasts the index of a part."""
    own_columns = docs.columns
    key, windows, items = fresh(docs, "_key"), fresh(docs, "_windows"), fresh(docs, "_items")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("length", pa.int32())]))

    def hit_by(index):
        def run(batches):
            for rows, data, at in blocks(batches):
                found = index.value.hits_by_text(Words(data, at, WORD))
                some = pa.array(sorted(found), pa.int64())
                spans = pa.array([[{"begin": b, "length": n} for b, n in found[d][0]] for d in sorted(found)], kind)
                yield pa.RecordBatch.from_arrays([rows.column(key).take(some), spans, pa.array([found[d][1] for d in sorted(found)], pa.list_(pa.string()))], names=[key, windows, items])

        return run

    hits = None
    for part in parts:
        index = load(part)
        own = tables.cut(keyed.select(key, "text").mapInArrow(hit_by(index), f"{key} binary, {windows} array<struct<begin:int,length:int>>, {items} array<string>").dropDuplicates([key]))
        index.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    hits = cut(hits.groupBy(key).agg(F.flatten(F.collect_list(windows)).alias(windows), F.flatten(F.collect_list(items)).alias(items)))
    # Rows go as one column, so that none of theirs is named like a column of the bitmap.
    some, rest = parted_by_members(keyed.select(F.struct(*docs.columns).alias("row"), key), hits, [key], hits.count())
    none = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in (windows, items)]
    found = some.join(hits, key, "left").select("row.*", windows, items).unionByName(rest.select("row.*", *none))

    def joined(rows, words):
        both = zip(rows.column(windows).to_pylist(), rows.column(items).to_pylist())
        return {d: ([(x["begin"], x["length"]) for x in own], some) for d, (own, some) in enumerate(both) if own}

    def run(batches):
        for rows, added in _with_hits(batches, joined):
            yield pa.RecordBatch.from_arrays([*rows.select(own_columns).columns, *added], names=names)

    return found.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", **how) -> DataFrame:
    """docs without contaminated documents (mode "document") or with hit spans cut out (mode "span").

    Columns stay as they are. A null text is never contaminated.
    """
    docs, restored = set_aside(docs, *_HITS.fieldNames())
    found = scan(docs, benchmark, **how)
    if mode == "document":
        return restored(found.filter("n_hit = 0"))
    if mode != "span":
        raise ValueError(f"unknown mode {mode!r}")
    # Kept pieces: from the end of each hit (or 0) to the start of the next (or the end).
    starts = F.concat(F.array(F.lit(0)), F.col("hit_spans.end"))
    ends = F.concat(F.col("hit_spans.start"), F.array(F.length("text")))
    kept = pieces_of(F.col("text"), starts, ends)
    return found.withColumn("text", F.when(F.col("n_hit") > 0, kept).otherwise(F.col("text"))).transform(restored)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bl AS (SELECT item, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bp AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
bg AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bp),
lengths AS (SELECT DISTINCT n FROM bg),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n),
dg AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp),
hits AS (SELECT rid, dg.n AS n, i, item FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
