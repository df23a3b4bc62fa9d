"""SimHash near-dedup: fingerprints of word shingles, compared at the anchors of a covering code."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .components import components
from .shared import LOWER, NOT_SPACE, Tables, blocks, bounded, cut, fresh

SHINGLE = 3
#: Fingerprints link at so many differing bits or fewer.
THRESHOLD = 2
_SEED = 42
#: Shingles whose bits are counted at a time.
_STEP = 1 << 16


def _shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, row) of the shingles of texts laid end to end; words in `text` have one space between them."""
    flags = NOT_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = flags[:-1], flags[1:]
    left[first[:-1]] = False
    right[first[1:]] = False
    kept = flags | left
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    text = np.where(flags, LOWER[data], np.uint8(32))[kept].tobytes()
    words = np.flatnonzero(flags & ~left)
    starts, ends = place[words], place[np.flatnonzero(flags & ~right) + 1]
    index = np.searchsorted(words, at)
    counts = np.diff(index)
    # A text of fewer words has one shingle, and its last word ends it.
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + index[:-1][row]
    return text, starts[begin], ends[np.minimum(begin + size, index[1:][row]) - 1], row


def _fingerprints(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text; 0 without words."""
    text, starts, ends, row = _shingles(data, at, size)
    ones = np.zeros((len(at) - 1, 64), np.int64)
    xx = xxhash.xxh64_intdigest
    for low in range(0, len(row), _STEP):
        part = slice(low, low + _STEP)
        hashes = np.array([xx(text[s:e], _SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[part]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    over = 2 * ones > np.bincount(row, minlength=len(ones))[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs without text, with fingerprint: 64 bits, each 1 if over half of the text's shingle hashes have it.

    A-Z are lowered, words end at white space (bytes 9 to 13 and 32), shingles are runs of `size` words with a space
    between them, repeats included; fewer words make one shingle. Hashes are XXH64 with seed 42. Null texts, empty
    ones and those without words have fingerprint 0. A column fingerprint is replaced.
    """
    docs = bounded(docs).drop("fingerprint")
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for rows, data, at in blocks(batches):
            made = pa.array(_fingerprints(data, at, size).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), made], names=[*kept, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name in kept] + [T.StructField("fingerprint", T.LongType())]))


#: Length, generator polynomial and covering radius of the binary Golay code, which is perfect.
_LENGTH, _GENERATOR, _RADIUS = 23, 0xC75, 3
_CHECKS = 11


class Golay:
    """Codewords round a vector of 23 bits, by its syndrome: just one lies within 3 bits; `rings` has those that lie beyond.

    rings[e] is a table of patterns (vector xor codeword) by syndrome with 3 + e bits, at e = 0 with 3 or fewer,
    and -1 where there are no more.
    """

    def __init__(self):
        remainders, r = [], 1
        for _ in range(_LENGTH):
            remainders.append(r)
            r <<= 1
            if r >> _CHECKS:
                r ^= _GENERATOR
        self.tables = np.zeros((3, 256), np.int64)
        for byte in range(3):
            for bit in range(8):
                if 8 * byte + bit < _LENGTH:
                    self.tables[byte] ^= np.where(np.arange(256) >> bit & 1, remainders[8 * byte + bit], 0)
        found: list[list[list[int]]] = [[[] for _ in range(1 << _CHECKS)] for _ in range(THRESHOLD + 1)]
        for weight in range(_RADIUS + THRESHOLD + 1):
            for bits in combinations(range(_LENGTH), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= remainders[b]
                found[max(weight - _RADIUS, 0)][syndrome].append(sum(1 << b for b in bits))
        self.rings = [np.array([x + [-1] * (max(map(len, ring)) - len(x)) for x in ring], np.int64) for ring in found]

    def syndromes(self, vectors: np.ndarray) -> np.ndarray:
        return self.tables[0][vectors & 255] ^ self.tables[1][vectors >> 8 & 255] ^ self.tables[2][vectors >> 16]


_code = cache(lambda: Golay())


def _anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home) of the anchors within covering radius plus threshold of each fingerprint.

    An anchor is a codeword in bits 0 to 22 and one in bits 23 to 45. Each half may exceed its radius, both by
    THRESHOLD in all: a fingerprint within the threshold has its home, where neither half exceeds it, in just such a place.
    """
    code = _code()
    halves = [prints.view(np.uint64) >> np.uint64(_LENGTH * i) & np.uint64((1 << _LENGTH) - 1) for i in (0, 1)]
    low, high = (h.astype(np.int64) for h in halves)
    low_s, high_s = code.syndromes(low), code.syndromes(high)
    index, anchor, home = [], [], []
    for e in range(THRESHOLD + 1):
        for f in range(THRESHOLD + 1 - e):
            a, b = code.rings[e][low_s][:, :, None], code.rings[f][high_s][:, None, :]
            there = (a >= 0) & (b >= 0)
            i = np.nonzero(there)[0]
            index.append(i)
            anchor.append((((low[:, None, None] ^ a) | (high[:, None, None] ^ b) << _LENGTH)[there]))
            home.append(np.full(len(i), e + f == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _near_anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, node, home) for distinct fingerprints (node)."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                column = batch.column("node").slice(low, 2048)
                index, anchor, home = _anchors(column.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(anchor), column.take(pa.array(index)), pa.array(home)], names=["anchor", "node", "home"])

    return nodes.mapInArrow(run, "anchor long, node long, home boolean")


#: Anchors that are home to more fingerprints than this are crowded: see _crowded_links.
CROWDED = 128


def _crowded_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within 2 bits of each other, without comparing any.

    The finest covering code, all vectors, has radius 0. Two fingerprints that differ in 2 bits are both within 1
    of a vector between them; any two within 1 of one vector differ in 2 bits at most. So each goes to itself and
    its 64 neighbours, and of those that meet all are linked to the smallest: 65 rows each, however many there are.
    """
    reach = [F.col("node").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64)]
    met = nodes.select("node", F.explode(F.array("node", *reach)).alias("at"))
    balls = met.groupBy("at").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)  # 65 at most
    return balls.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b").distinct()


def links(prints: DataFrame, tables: Tables, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b or a the smallest of several, whose components are those of all pairs within the threshold.

    prints has a column node, distinct fingerprints. Each has one home, the anchor within the covering radius, and is
    a guest of every anchor within covering radius plus threshold. Of two within the threshold, the larger one is
    a guest at the smaller one's home: there all guests are compared with those at home.
    """
    near = tables.cut(_near_anchors(prints))
    counts = near.filter("home").groupBy("anchor").agg(F.count("*").alias("n"))
    full = tables.cut(counts.filter(F.col("n") > crowded).select("anchor"))
    homes = near.filter("home").select("anchor", F.col("node").alias("a"))
    any_full = not full.isEmpty()
    if any_full:
        homes = homes.join(full.hint("merge"), "anchor", "left_anti")
    guests = near.select("anchor", F.col("node").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    found = guests.join(homes.hint("merge"), "anchor").filter((F.col("a") < F.col("b")) & close).select("a", "b")
    out = tables.cut(found)
    if any_full:
        inside = near.join(full.hint("merge"), "anchor", "left_semi").select("node").distinct()
        out = out.unionByName(tables.cut(_crowded_links(inside)))
    tables.drop(near, full)
    return out


def linked_fingerprints(docs: DataFrame, size: int = SHINGLE, crowded: int = CROWDED) -> DataFrame:
    """docs without text, with fingerprint and root: rows whose fingerprints are linked, directly or not, have one root.

    Fingerprints link if they differ in THRESHOLD bits or fewer; so all texts without words are linked,
    and with any whose fingerprint is close to 0. Rows of a null or repeated doc_id link by their texts. Equal
    fingerprints are one node, and only distinct ones meet at anchors (see links). A column root is replaced.

    Intermediate tables are deleted on the way; the result is a written table.
    """
    with Tables(docs.sparkSession) as tables:
        rows = tables.cut(fingerprints(docs.drop("root"), size))
        nodes = tables.cut(rows.select(F.col("fingerprint").alias("node")).distinct())
        found = links(nodes, tables, crowded)
        n = found.count()
        if not n:
            return cut(rows.withColumn("root", F.col("fingerprint")))
        roots = components(found, tables, n).select(F.col("node").alias("_node"), "root")
        out = rows.join(roots.hint("merge"), F.col("fingerprint") == F.col("_node"), "left")
        return cut(out.withColumn("root", F.coalesce("root", "fingerprint")).drop("_node"))


def linked_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: the fingerprint as 16 hexadecimal digits, the smallest doc_id of its component.

    A component of null ids only has a null component_id.
    """
    rows = linked_fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), **how)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least.hint("merge"), "root").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Of equal rows one stays. Texts without words, null ones too, are near copies of each other.
    """
    i, k = fresh(docs, "_id"), fresh(docs, "_key")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), "text")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")
    kept = linked_fingerprints(named, **how).groupBy("root").agg(best).select(F.col("best.doc_id").alias(i), F.col("best.text_key").alias(k))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col(k))
    return docs.join(kept, same).dropDuplicates([i, k]).select(*docs.columns)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
