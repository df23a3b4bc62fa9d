"""N-gram Jaccard join: prefix filters under several global token orders, intersected, then exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .components import components
from .shared import NOT_SPACE, Tables, Words, blocks, bounded, cut, fresh, mix

SHINGLE = 4
PERCENT = 85
#: Counters of the frequency sketch. Its size is fixed, so it can be broadcast; any counts give a valid order.
COUNTERS = 1 << 20
_CHUNK = 1 << 12
#: Buckets of at most so many members are compared pair by pair once their hub has joined what it can.
SMALL = 64
#: Prefixes of at most so many tokens are kept with 16 bits a token in the other orders.
NARROW = 256
#: Sets of at most so many tokens are kept with 16 bits a token to reject pairs before whole sets move.
BRIEF = 1024
_ORDERS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _shingles(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for a text of fewer words, none without words."""
    words = Words(data, at, NOT_SPACE)
    begin, hashes = words.windows(size)
    low = np.searchsorted(begin, words.first)
    out = []
    for d, n in enumerate(words.counts):
        if n >= size:
            out.append(np.unique(hashes[low[d] : low[d + 1]]))
        elif n:
            out.append(np.array([hash_short(words, int(words.first[d]), int(n))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hash_short(words: Words, low: int, n: int) -> np.uint64:
    h = np.array([n], np.uint64)
    for i in range(low, low + n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words.hashes[i : i + 1])
    return h[0]


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Documents that each counter's shingles stand in, over all documents: 8 bytes for each of COUNTERS."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, data, at in blocks(batches):
            sets = _shingles(data, at, size)
            if sets:
                total += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
        parts = total.reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        for low in range(0, len(some), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[low : low + 16]), pa.array([parts[i].tobytes() for i in some[low : low + 16]], pa.binary())], names=["part", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, np.int64)
                total[part] = total[part] + counts if part in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    schema = "part long, counts binary"
    n = 32  # COUNTERS numbers a task of the first stage are added by so many
    added = docs.select("text").mapInArrow(count, schema).repartition(n, "part").coalesce(n).mapInArrow(add, schema)
    out = np.zeros((COUNTERS // _CHUNK, _CHUNK), np.int64)
    for row in added.collect():  # COUNTERS numbers in all
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def _set_hash(s: np.ndarray) -> int:
    sums = np.bitwise_xor.reduce(mix(s), keepdims=True) + mix(s + np.uint64(1)).sum(keepdims=True) + np.array([len(s)], np.uint64)
    return int(mix(sums).view(np.int64)[0])


def _set_check(s: np.ndarray) -> int:
    """64 more bits of a set, which tell sets of one hash apart."""
    sums = mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(keepdims=True) ^ np.bitwise_xor.reduce(mix(s + np.uint64(2)), keepdims=True)
    return int(mix(sums).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n that hold at least one token of every linked set, under any one order of all tokens."""
    return n - (percent * n + 99) // 100 + 1


_SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.BinaryType()),
        T.StructField("n_shingles", T.IntegerType()),
        T.StructField("node", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("orders", T.ArrayType(T.BinaryType())),
    ]
)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("text_key"), "text")


def _rarest(s: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
    """The first n of a set by rising frequency, ties by hash: the same order in every set."""
    return s[np.lexsort((mix(s), frequency[_counter(s)]))[:n]].view(np.int64)


def _sketches(docs: DataFrame, size: int, percent: int, counts) -> DataFrame:
    """For each document its set's size and hash (node, check), its prefix by rising frequency, and those of other orders.

    A set that a task has met before gets empty prefixes: one is enough, and a group of copies is not exploded.
    Prefixes of the other orders only reject pairs, so a few bits of each token do (see _packed).
    """

    def run(batches):
        frequency, met = counts.value, set()
        for rows, data, at in blocks(batches):
            sets = _shingles(data, at, size)
            nodes, checks, rare, orders = [], [], [], []
            for s in sets:
                nodes.append(_set_hash(s) if len(s) else 0)
                checks.append(_set_check(s) if len(s) else 0)
                p = prefix_length(len(s), percent) if len(s) and (nodes[-1], checks[-1]) not in met else 0
                met.add((nodes[-1], checks[-1]))
                rare.append(_rarest(s, frequency, p) if p else np.zeros(0, np.int64))
                orders.append([])
                for salt in _ORDERS if p else ():
                    ranks = mix(s ^ salt)
                    first = np.partition(ranks, p - 1)[:p] if p < len(s) else ranks
                    orders[-1].append(_packed(first))
            sizes = pa.array([len(s) for s in sets], pa.int32())
            prefixes = [pa.array(rare, pa.list_(pa.int64())), pa.array(orders, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), sizes, pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), *prefixes], names=_SKETCH.fieldNames())

    return _keyed(docs).mapInArrow(run, _SKETCH)


def told_apart(sketches: DataFrame, tables: Tables) -> DataFrame:
    """sketches in which sets that differ have different nodes: where a hash has several checks, each gets a node of its own."""
    checks = sketches.filter("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    several = tables.cut(checks.filter("low <> high").select("node", F.lit(True).alias("several")))
    if several.isEmpty():
        return sketches
    own = F.when(F.col("several") & (F.col("n_shingles") > 0), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return sketches.join(several, "node", "left").withColumn("node", own).drop("several")


def _packed(tokens: np.ndarray, narrow: int = NARROW) -> bytes:
    """The upper 16 bits of each token; 32 of more than `narrow` tokens, which by chance would meet too often else."""
    return (tokens >> np.uint64(48)).astype("<u2").tobytes() if len(tokens) <= narrow else (tokens >> np.uint64(32)).astype("<u4").tobytes()


def _in_common(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """How many of n_x and n_y packed tokens may be the same at most: bits count as often as both have them."""
    if not n_x or not n_y:
        return 0
    (a, wide), (b, other) = ((np.frombuffer(v, "<u2" if len(v) == 2 * n else "<u4"), len(v) > 2 * n) for v, n in ((x, n_x), (y, n_y)))
    if wide != other:
        a, b = (a >> 16 if wide else a), (b >> 16 if other else b)
    a, many = np.unique(a, return_counts=True)
    b, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(many[i], more[j]).sum())


def _least_total(n_x: int, n_y: int, percent: int) -> int:
    """The smallest intersection of linked sets of these sizes."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def _least_in_prefixes(n_x: int, n_y: int, percent: int) -> int:
    """Tokens that the prefixes of linked sets of n_x and n_y tokens share at least, under any one order.

    Of an overlap, no more lies behind a prefix than that prefix leaves of its own set; and of the two
    prefixes, the one that ends first in the order leaves none of the other's tokens before its end.
    """
    return max(1, _least_total(n_x, n_y, percent) - max(n - prefix_length(n, percent) for n in (n_x, n_y)))


def _meeting(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, .., big, orders_a, orders_b) with meets: whether their prefixes share enough under each of the other orders.

    Pairs that do not cannot link; they go, but for those of big buckets, whose members are needed to refine these.
    """

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "orders_a", "orders_b"))
            meets = []
            for n_a, n_b, a, b in zip(*columns):
                least, sizes = _least_in_prefixes(n_a, n_b, percent), (prefix_length(n_a, percent), prefix_length(n_b, percent))
                meets.append(all(_in_common(x, sizes[0], y, sizes[1]) >= least for x, y in zip(a, b)))
            out = batch.select(_PAIR).append_column("meets", pa.array(meets, pa.bool_()))
            yield out.filter(pc.or_(out.column("meets"), out.column("big")))

    return pairs.select(*_PAIR, "orders_a", "orders_b").mapInArrow(run, "a long, n_a int, b long, n_b int, central double, big boolean, meets boolean")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, .., meets, brief_a, brief_b) without those that cannot link, by a few bits of each token; those of big buckets stay."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("big", "n_a", "n_b", "brief_a", "brief_b"))
            may = [big or _in_common(a, n_a, b, n_b) >= _least_total(n_a, n_b, percent) for big, n_a, n_b, a, b in zip(*columns)]
            yield batch.select([*_PAIR, "meets"]).filter(pa.array(may, pa.bool_()))

    return pairs.select(*_PAIR, "meets", "brief_a", "brief_b").mapInArrow(run, "a long, n_a int, b long, n_b int, central double, big boolean, meets boolean")


def least_overlap(n_a, n_b, percent: int):
    """The smallest intersection of linked sets of these sizes."""
    total = percent * (n_a + n_b)
    return F.ceil(total / F.lit(100 + percent)).cast("long")


_PAIR = ["a", "n_a", "b", "n_b", "central", "big"]


def _verified(pairs: DataFrame, percent: int, counts) -> DataFrame:
    """For pairs (a, .., meets, set_a, set_b): what they share (common), whether they link, and in big buckets the tokens of b to refine by.

    A set that links with b shares at least that percentage of b with it, so, but for what a has of b, at least
    `outside` tokens that a lacks. All sets that share so many with b outside a meet it in a prefix of these tokens.
    """

    def run(batches):
        frequency = counts.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = batch.slice(low, 64)
                common, linked, rest = [], [], []
                for a, b, big, meets in zip(*(rows.column(c).to_pylist() for c in ("set_a", "set_b", "big", "meets"))):
                    a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                    own = np.setdiff1d(b, a, assume_unique=True)
                    both = len(b) - len(own)
                    common.append(both)
                    linked.append(meets and 100 * both >= percent * (len(a) + len(b) - both))
                    outside = max((percent * len(b) + 99) // 100 - both, 1)
                    rest.append(_rarest(own, frequency, max(len(own) - outside + 1, 0)) if big else np.zeros(0, np.int64))
                added = [pa.array(common, pa.int32()), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("a", "b", "n_b", "central", "big")), *added], names=["a", "b", "n_b", "central", "big", "common", "linked", "rest"])

    return pairs.mapInArrow(run, "a long, b long, n_b int, central double, big boolean, common int, linked boolean, rest array<bigint>")


#: Bits of the filter that keeps most unwanted texts from being shuffled. Its size is fixed; it drops no wanted one.
FILTER_BITS = 1 << 23


def _bits(keys: pa.Array) -> np.ndarray:
    """A bit of the filter for each key of 16 bytes; null keys share the first."""
    keys = b"".join(k or bytes(16) for k in keys.to_pylist())
    return (np.frombuffer(keys, "<u8")[::2] >> np.uint64(41)).astype(np.int64)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of text_key of wanted."""

    def mark(batches):
        flags = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            flags[_bits(batch.column("text_key"))] = 1
        parts = np.packbits(flags).reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def unite(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                bits = np.frombuffer(bits, np.uint8)
                total[part] = total[part] | bits if part in total else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "bits"])

    schema = "part long, bits binary"
    united = wanted.select("text_key").mapInArrow(mark, schema).repartition(16, "part").coalesce(16).mapInArrow(unite, schema)
    out = np.zeros((FILTER_BITS // 8 // _CHUNK, _CHUNK), np.uint8)
    for row in united.collect():  # FILTER_BITS in all
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles, brief) for wanted (node, doc_id, text_key): the set of one text of each node, packed, whole and with a few bits of each token."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches):
        # Texts that are not wanted neither become sets nor are shuffled.
        wanted = (batch.filter(pa.array(bitmap.value[_bits(batch.column("text_key"))])) for batch in batches)
        for rows, data, at in blocks(wanted):
            sets = _shingles(data, at, size)
            columns = [pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([_packed(s, BRIEF) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), *columns], names=["doc_id", "text_key", "shingles", "brief"])

    found = _keyed(docs).mapInArrow(run, "doc_id long, text_key binary, shingles binary, brief binary")
    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    found = found.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    # Equal rows give a node more than once.
    return found.select("node", "shingles", "brief").dropDuplicates(["node"])


def _grown(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join of two tables that both grow with the input: it is shuffled at every size, so that a small input shows what a large one needs."""
    return left.join(right.hint("merge"), key)


def linked_roots(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, root) for each row of docs; rows of one component have one root, empty sets none.

    Words end at white space (bytes 9 to 13 and 32), A-Z are lowered. A document's set has its distinct shingles
    of `size` words, or all its words as one if there are fewer; null and empty texts have an empty set and no
    link. Two documents link if 100 * intersection >= percent * union. Ids play no part: rows of a null or a
    repeated doc_id link by their texts. Sets are compared by 64-bit hashes of shingles.

    Equal sets are one node; sets count as equal if 128 bits of them are. A linked pair shares a token in the prefixes of both sets under any order of all
    tokens: postings of the rarest-first prefixes give candidates, which must also meet under each of the other
    orders before they are verified.

    A bucket of postings is first compared with one member only, its hub, the one that shares most with others.
    In a small bucket the pairs of different components that remain are verified in the next round. A large
    one is refined: members x and y of a hub h that share nothing outside h share at most the smaller of what
    each shares with h, so they can only link if they meet in a token outside h or if both hold enough of h.
    The bucket is replaced by one for each token in a prefix of what stands outside (see _verified), and one for
    those that hold enough, in which only pairs that both hold enough for their two sizes count. So no bucket is
    cut short, and a group of near copies costs its size, not its square. After ROUNDS rounds what is still open
    is compared pair by pair.

    Intermediate tables are deleted on the way; the result is a written table.
    """
    with Tables(docs.sparkSession) as tables:
        return cut(_Join(bounded(docs), size, percent, tables).run())


#: Rounds after which open buckets are compared pair by pair, whatever their size.
ROUNDS = 6
#: A large bucket with at most so many members outside its largest component is compared directly too, and one
#: of members that hold enough of a hub if that takes at most so many tests of two numbers.
FEW = 16
TESTS = 1 << 22
#: Postings of a token beyond this many are dealt over several tasks.
HOT = 1 << 13

_POSTING = ("token", "node", "n", "central", "held")


class _Join:
    """One run: the tables that all rounds need, links found so far and their components."""

    def __init__(self, docs: DataFrame, size: int, percent: int, tables: Tables):
        self.docs, self.size, self.percent, self.tables = docs, size, percent, tables
        self.counts = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, size))
        self.roots = self.links = self.sets = self.members = self.against = None
        self.n_links = 0

    def run(self) -> DataFrame:
        tables = self.tables
        sketches = tables.cut(_sketches(self.docs, self.size, self.percent, self.counts))
        labelled = told_apart(sketches, tables)
        postings, direct = self.first_postings(labelled), None
        ends = tables.cut(labelled.select("doc_id", "text_key", "n_shingles", "node"))
        tables.drop(sketches)
        opened, rounds = postings, 0
        while postings is not None:
            pairs = self.across(direct).unionByName(self.with_hubs(postings)) if direct is not None else self.with_hubs(postings)
            against = self.compare(pairs)
            # Small buckets of the first round are compared with their hubs only, and directly in the next.
            again = postings.filter(F.col("k") <= SMALL).select(*_POSTING) if rounds == 0 else None
            refined = self.refine(against, again) if against is not None or again is not None else None
            rounds += 1
            before, opened = opened, self.open(refined, rounds) if refined is not None else None
            tables.drop(before, self.against)
            postings, direct = (opened.filter("not direct").select(*_POSTING, "k"), opened.filter("direct")) if opened is not None else (None, None)
        ends = ends.join(self.roots.select("node", "root"), "node", "left") if self.roots is not None else ends.withColumn("root", F.lit(None).cast("long"))
        return ends.select("doc_id", "text_key", F.col("n_shingles").cast("long"), F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root"))

    def first_postings(self, sketches: DataFrame) -> DataFrame:
        """(token, node, n, central, held, k) of tokens that more than one node has in its prefix; k: about how many."""
        tables = self.tables
        sets = sketches.filter(F.size("rare") > 0)
        raw = sets.select("node", F.explode("rare").alias("token"))
        # Copies of one set in several tasks count too; a bucket of nothing else makes no pair.
        counted = raw.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
        shared = tables.cut(_grown(raw, counted, "token").select("token", "node", "k"))
        # The most central member of a bucket has the most tokens that others have too.
        central = shared.groupBy("node").agg(F.round(F.sum(F.log2("k")), 3).alias("central"))
        nodes = sets.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("orders").alias("orders"), F.min(F.struct("doc_id", "text_key")).alias("at"))
        self.members = members = tables.cut(_grown(nodes, central, "node").select("node", "n", "central", "orders", F.col("at.doc_id").alias("doc_id"), "at.text_key"))
        postings = tables.cut(_grown(shared, members.select("node", "n", "central"), "node").select("token", "node", "n", "central", F.lit(None).cast("int").alias("held"), "k"))
        tables.drop(shared)
        return postings

    def with_hubs(self, postings: DataFrame) -> DataFrame:
        """_PAIR: each member with the hub of its bucket; big if any of their buckets is large. Hot tokens are salted."""
        hubs = postings.groupBy("token").agg(F.max(F.struct("central", "node", "n")).alias("hub"), F.max("k").alias("k"))
        parts = F.ceil(F.col("k") / HOT).cast("int")
        hubs = hubs.select("token", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a"))
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
        pairs = salted.join(hubs, ["token", "salt"]).filter("a <> node")
        # A member's size, score and k do not depend on the bucket, so any of its rows will do.
        return pairs.groupBy("a", F.col("node").alias("b")).agg(F.first("n_a").alias("n_a"), F.first("n").alias("n_b"), F.first("central").alias("central"), (F.max("k") > SMALL).alias("big")).select(*_PAIR)

    def across(self, direct: DataFrame) -> DataFrame:
        """_PAIR: pairs of different components in a bucket that their sizes, and what they hold of a hub, let link."""
        one = direct.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), "largest", F.col("held").alias("held_a"))
        two = direct.filter("root <> largest").select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("held").alias("held_b"), "central")
        enough = F.col("held_a").isNull() | (least_overlap(F.col("n_a"), F.col("n_b"), self.percent) <= F.least("held_a", "held_b"))
        # Of two members outside the largest component each is b once; the smaller node counts.
        once = (F.col("root_a") == F.col("largest")) | (F.col("a") < F.col("b"))
        pairs = two.join(one, "token").filter((F.col("root_a") != F.col("root_b")) & once & self._close() & enough)
        return pairs.dropDuplicates(["a", "b"]).withColumn("big", F.lit(False)).select(*_PAIR)

    def _close(self):
        low, high = F.least("n_a", "n_b").cast("long"), F.greatest("n_a", "n_b").cast("long")
        return 100 * low >= self.percent * high

    def compare(self, pairs: DataFrame) -> DataFrame | None:
        """Verifies the pairs that pass the filters of sizes and of the other orders, links them, and returns those of big buckets."""
        tables = self.tables
        orders = lambda c: self.members.select(F.col("node").alias(c), F.col("orders").alias(f"orders_{c}"))
        pairs = pairs.filter(F.col("big") | self._close())
        pairs = tables.cut(_meeting(_grown(_grown(pairs, orders("b"), "b"), orders("a"), "a"), self.percent))
        if not (n := pairs.count()):
            self.against = None
            return None
        self._fetch(pairs)
        briefs = lambda c: self.sets.select(F.col("node").alias(c), F.col("brief").alias(f"brief_{c}"))
        sets = lambda c: self.sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
        likely = tables.cut(_likely(_grown(_grown(pairs, briefs("b"), "b"), briefs("a"), "a"), self.percent), n)
        self.against = done = tables.cut(_verified(_grown(_grown(likely, sets("b"), "b"), sets("a"), "a"), self.percent, self.counts), n)
        tables.drop(likely)
        links = tables.cut(done.filter("linked").select("a", "b"), n)
        tables.drop(pairs)
        if n := links.count():
            self.links = links if self.links is None else self.links.unionByName(links)
            self.n_links += n
            before, self.roots = self.roots, components(self.links, tables, self.n_links)
            if before is not None:
                tables.drop(before)
        return done.filter("big")

    def _fetch(self, pairs: DataFrame) -> None:
        """Adds the sets that pairs need to those that earlier rounds have needed."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.tables.cut(_grown(self.members, wanted, "node").select("node", "doc_id", "text_key"))
        more = self.tables.cut(_sets(self.docs, wanted, self.size))
        self.tables.drop(wanted)
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def _rooted(self, df: DataFrame, node: str = "node") -> DataFrame:
        if self.roots is None:
            return df.withColumn("root", F.col(node))
        roots = self.roots.select(F.col("node").alias("_node"), "root")
        return df.join(roots, df[node] == roots["_node"], "left").withColumn("root", F.coalesce("root", node)).drop("_node")

    def refine(self, against: DataFrame | None, again: DataFrame | None) -> DataFrame:
        """Postings of the buckets that take the place of large ones, and those of `again`."""
        if against is None:
            return again
        # Only hubs with members of several components go on.
        rooted = self._rooted(against.select("a", "b", "n_b"), "b")
        still = rooted.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n_b").alias("least")).filter("low <> high").select("a", "least")
        against = against.join(still, "a").withColumnsRenamed({"b": "node", "n_b": "n"})
        outside = against.select("a", "node", "n", "central", F.explode("rest").alias("_t")).select(F.xxhash64("a", "_t").alias("token"), "node", "n", "central", F.lit(None).cast("int").alias("held"))
        enough = against.filter(F.col("common") >= least_overlap(F.col("n"), F.col("least"), self.percent)).select(F.xxhash64("a", F.lit("enough")).alias("token"), "node", "n", "central", F.col("common").alias("held"))
        out = outside.unionByName(enough)
        return out if again is None else out.unionByName(again)

    def open(self, postings: DataFrame, rounds: int) -> DataFrame | None:
        """Postings of buckets with several components, with k, root, the largest component, and whether to compare them directly."""
        rooted = self._rooted(postings)
        parts = rooted.groupBy("token", "root").agg(F.count("*").alias("k"))
        buckets = parts.groupBy("token").agg(F.sum("k").alias("k"), F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
        others = F.col("k") - F.col("top.k")
        buckets = buckets.select("token", "k", F.col("top.root").alias("largest"), ((F.col("k") <= SMALL) | (others <= FEW) | F.lit(rounds >= ROUNDS)).alias("direct"), (others * F.col("k")).alias("tests"))
        direct = F.col("direct") | (F.col("held").isNotNull() & (F.col("tests") <= TESTS))
        opened = self.tables.cut(rooted.join(buckets, "token").select(*_POSTING, "k", "root", "largest", direct.alias("direct")))
        return None if opened.isEmpty() else opened


def linked_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the smallest doc_id of its component (see linked_roots).

    A document without shingles is alone; a component of null ids only has a null component_id.
    """
    ends = linked_roots(docs, **how)
    least = ends.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return ends.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Of equal rows one stays. Rows without shingles, null and empty texts among them, all stay, and are not shuffled.
    """
    ends = linked_roots(docs.select("doc_id", "text"), **how)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")
    i, k, many = fresh(docs, "_id"), fresh(docs, "_key"), fresh(docs, "_many")
    rows = ends.filter("root is not null")
    kept = rows.groupBy("root").agg(best).select("best.doc_id", "best.text_key")
    # Only rows that stand more than once have to be told apart.
    copies = rows.groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias(many)).withColumnsRenamed({"doc_id": i, "text_key": k})
    kept = kept.join(copies, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_key") == F.col(k))).select(i, k, many)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = docs.filter(worded).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.unhex(F.md5("text")) == F.col(k)))
    single = found.filter(~F.col(many)).select(*docs.columns)
    first = found.filter(F.col(many)).dropDuplicates([i, k]).select(*docs.columns)
    return docs.filter(~worded).unionByName(single).unionByName(first)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_components(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0
), s AS (SELECT DISTINCT rid, array_to_string(w[i:least(i + 3, len(w))], ' ') AS g FROM p),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (
  SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT a AS rid, a AS at FROM e UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.at),
m AS (SELECT r.rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.at GROUP BY r.rid)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
