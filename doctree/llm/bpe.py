"""Byte-level BPE with a rank queue: buckets of linked-list positions per merge rank, found through a bitmap hierarchy."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import _BYTE, blocks, bounded, range_hashes

#: Encodings of short pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Longer pre-tokens, in bytes, are encoded each time.
SHORT = 48
_BITS = 8
_WORD = (1 << _BITS) - 1


class RankQueue:
    """Merge ranks, each with a bucket of positions; `lowest` takes out the bucket of the lowest rank.

    The bitmap has two levels of 256-bit words, so that finding a rank takes two find-first-sets.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((ranks >> _BITS) + 1)
        self.top = 0

    def fill(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        self.words[rank >> _BITS] |= 1 << (rank & _WORD)
        self.top |= 1 << (rank >> _BITS)

    def lowest(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        low = word & -word
        self.words[at] = word = word ^ low
        if not word:
            self.top = top & (top - 1)
        rank = at << _BITS | low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Merger:
    """Merges the bytes of pre-tokens by ranks (bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.lengths = [0] * self.size
        self.pairs = np.full(1 << 16, -1, np.int64)
        self.singles = np.zeros(256, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
            elif len(token) == 1:
                self.singles[token[0]] = rank

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and where each piece's begin (one more than pieces).

        The pieces lie in one linked list and share one queue. A piece's merges are those of the lowest rank,
        the leftmost first, whatever the others do: a bucket is worked off from the left, and what is left of
        it goes back if a merge makes a pair of a lower rank.
        """
        ranks, lengths = self.ranks, self.lengths
        text = b"".join(pieces)
        n = len(text)
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=bounds[1:])
        data = np.frombuffer(text, np.uint8)
        edge = np.zeros(n + 1, np.uint8)
        edge[bounds] = 1
        queue = RankQueue(self.size)
        if n > 1:
            first = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
            at = np.flatnonzero((first >= 0) & (edge[1:n] == 0))
            at = at[np.argsort(first[at], kind="stable")]
            kinds, cuts = np.unique(first[at], return_index=True)
            for rank, some in zip(kinds.tolist(), np.split(at, cuts[1:])):
                queue.fill(rank, some.tolist())
        ids = self.singles[data].tolist()
        alive, edge = bytearray(b"\1") * n, bytearray(edge)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, waiting, fill = ranks.get, queue.buckets, queue.fill
        while (top := queue.lowest()) is not None:
            rank, bucket = top
            length = lengths[rank]
            bucket.sort()
            low = rank
            for k, i in enumerate(bucket):
                # Stale unless two symbols of the right length together still begin here.
                if not alive[i] or edge[middle := end[i]] or (last := end[middle]) - i != length:
                    continue
                alive[middle] = 0
                end[i] = last
                ids[i] = rank
                if not edge[last]:
                    before[last] = i
                    if (new := get(text[i : end[last]])) is not None:
                        if new in waiting:
                            waiting[new].append(i)
                        else:
                            fill(new, [i])
                        if new < low:
                            low = new
                if not edge[i]:
                    left = before[i]
                    if (new := get(text[left:last])) is not None:
                        if new in waiting:
                            waiting[new].append(left)
                        else:
                            fill(new, [left])
                        if new < low:
                            low = new
                if low < rank:
                    if k + 1 < len(bucket):
                        fill(rank, bucket[k + 1 :])
                    break
        kept = np.flatnonzero(np.frombuffer(alive, np.uint8))
        return np.array(ids, np.int64)[kept], np.searchsorted(kept, bounds)


def _classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, found in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(found, every):
            low, high = ord(every[m.start()]), ord(every[m.end() - 1])
            out[low : high + 1] = kind
    out[0xD800:0xE000] = 0
    return out


#: What the pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The pattern that `Splitter` does by arrays; any other is left to the regex library.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """Bounds of pre-tokens in the bytes of texts laid end to end."""

    def __init__(self, pattern: str):
        self.find = None if pattern == KNOWN_PATTERN else regex.compile(pattern).finditer
        self.classes = _classes() if self.find is None else None

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first byte of each pre-token. The pattern leaves no byte out."""
        if self.find is not None:
            out = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                text = data[low:high].tobytes().decode()
                ends = [m.end() for m in self.find(text)]
                if sum(m.end() - m.start() for m in self.find(text)) != len(text):
                    raise ValueError("the pattern leaves text out")
                out.append(low + np.concatenate([[0], np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *ends], ends)])])[:-1])
            return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[code]
        begins = np.zeros(n + 1, bool)  # of texts
        begins[np.searchsorted(lead, at)] = True
        run = begins.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        run[n] = True
        first = np.flatnonzero(run[:n])
        after = np.append(first[1:], n)
        size = after - first
        space = kind[first] == 3
        mark = np.zeros(n + 1, bool)
        mark[first] = True
        # White space before something else in its text: all but the last is a token, and the last, if a space, begins the next one.
        led = space & ~begins[after]
        last = after[led] - 1
        mark[last] = True
        mark[after[led][code[last] == 32]] = False
        # An apostrophe that begins a token, alone before a letter.
        quote = np.flatnonzero(~space & (size == 1))
        quote = first[quote]
        quote = quote[(code[quote] == 39) & mark[quote]]
        quote = quote[~begins[quote + 1]]
        for q in quote.tolist():
            rest = "".join(map(chr, code[q + 1 : q + 3]))
            end = 2 if begins[q + 2] else 3
            for c in CONTRACTIONS:
                if rest[: end - 1].startswith(c):
                    mark[q + 1] = False
                    # What follows is a token of its own: already so unless it goes on with letters.
                    past = q + 1 + len(c)
                    if past < n and not begins[past] and kind[past] == 1:
                        mark[past] = True
                        if len(c) == 2:
                            mark[q + 2] = False
                    break
        return lead[np.flatnonzero(mark[:n])]


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, .. of each run, one run after another."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(first - (total - counts), counts) + np.arange(total[-1])


class Encoder:
    """Encodes texts by merge ranks and a splitting pattern, without special tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.remembered = ranks, remembered
        self.merger, self.splitter = Merger(ranks), Splitter(pattern)
        tokens = [b""] * self.merger.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = self._table(tokens)
        self.decimals = self._table([b"%d," % i for i in range(self.merger.size)])
        self._forget()

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(counts) - counts, counts

    @staticmethod
    def _join(table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all ids end to end, and the bytes before each (one more than ids)."""
        flat, first, counts = table
        sizes = counts[ids]
        return flat[_ragged(first[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.first, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.kept = 0

    def _remember(self, ids: np.ndarray, cuts: np.ndarray) -> int:
        """Adds the ids of some pre-tokens; the number of the first of them."""
        k, m, n = self.kept, len(cuts) - 1, len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + m > len(self.first):
            self.first, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.counts))
        self.flat[self.used : self.used + n] = ids
        self.first[k : k + m] = cuts[:-1] + self.used
        self.counts[k : k + m] = np.diff(cuts)
        self.used += n
        self.kept += m
        return k

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts laid end to end, and where each text's begin (one more than texts)."""
        starts = self.splitter.starts(data, at)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(data))
        kinds, sample, where = np.unique(range_hashes(_BYTE[data], starts, ends), return_index=True, return_inverse=True)
        if self.kept > self.remembered:
            self._forget()
        known = self.known
        number = np.array([known.get(h, -1) for h in kinds.tolist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            low, high = starts[sample[new]].tolist(), ends[sample[new]].tolist()
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(low, high)]
            whole = [self.ranks.get(p) for p in pieces]
            broken = [k for k, w in enumerate(whole) if w is None]
            ids, cuts = self.merger.merge([pieces[k] for k in broken])
            sizes = np.ones(len(pieces), np.int64)
            sizes[broken] = np.diff(cuts)
            all_cuts = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.zeros(all_cuts[-1], np.int64)
            entire = np.array([k for k, w in enumerate(whole) if w is not None], np.int64)
            flat[all_cuts[entire]] = [whole[k] for k in entire]
            flat[_ragged(all_cuts[broken], sizes[broken])] = ids
            base = self._remember(flat, all_cuts)
            number[new] = base + np.arange(len(new))
            known.update((h, base + k) for k, (h, p) in enumerate(zip(kinds[new].tolist(), pieces)) if len(p) <= SHORT)
        number = number[where]
        counts = self.counts[number]
        ids = self.flat[_ragged(self.first[number], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, at)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_block(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids) -> bytes:
        return self._join(self.tokens, np.asarray(ids, np.int64))[0].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


_KEPT: dict[tuple[str, str], Encoder] = {}


def _encoder(name: str, pattern: str) -> Encoder:
    if (name, pattern) not in _KEPT:
        _KEPT[name, pattern] = Encoder(load_ranks(SparkFiles.get(name)), pattern)
    return _KEPT[name, pattern]


def _shipped(spark: SparkSession, path: str) -> str:
    """Sends the rank file, a fixed vocabulary, to all executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds token_ids (array of int) for each whole text; null counts as empty, empty gives an empty array.

    Rows stay as they are, repeated ones too; a column that is called token_ids is replaced. Texts of any
    length are encoded whole: a pre-token of n bytes takes about n log n steps.
    """
    docs = bounded(docs).drop("token_ids")
    name = _shipped(docs.sparkSession, path)

    def run(batches):
        coder = _encoder(name, pattern)
        for rows, data, at in blocks(batches):
            ids, cuts = coder.encode_block(data, at)
            found = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, "token_ids"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary) for token_ids; null or empty ids give no bytes, an id that the ranks lack fails."""
    encoded = bounded(encoded).drop("decoded")
    name = _shipped(encoded.sparkSession, path)

    def run(batches):
        coder = _encoder(name, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64)
                out = pa.array([coder.decode(x or ()) for x in rows.column("token_ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType(encoded.schema.fields + [T.StructField("decoded", T.BinaryType())]))


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with the number of ids, their digest and the digest of what they decode to, in one pass.

    The same encoder and decoder as `encode` and `decode`, without passing ids and bytes to Spark and back.
    """
    name = _shipped(docs.sparkSession, path)

    def run(batches):
        coder = _encoder(name, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows, data, at in blocks(batches):
            ids, cuts = coder.encode_block(data, at)
            out: list[list[str]] = []
            for table, tail in ((coder.decimals, 1), (coder.tokens, 0)):
                flat, before = coder._join(table, ids)
                edges = before[cuts].tolist()
                flat = memoryview(np.ascontiguousarray(flat))
                out.append([sha(flat[a : max(a, b - tail)]) for a, b in zip(edges, edges[1:])])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(cuts)), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DIGESTS)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
