"""Fill-in-the-middle: texts as ropes, split at two unit ranks and put together anew round sentinels; and back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import blocks, bounded, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many change form, and of those so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = "1"
#: Code points of a leaf, but for a single longer unit.
LEAF = 2048


class Units:
    """What a text may be cut between: its code points, or the matches of a pattern, matched left to right from the text's begin.

    What no match covers is a part of the next unit, at the end a unit of its own. A pattern must not look behind a match.
    """

    def __init__(self, pattern: str | None = None):
        self.pattern = re.compile(pattern) if pattern else None

    def _ends(self, text: str):
        at = 0
        for m in self.pattern.finditer(text):
            if m.end() > at:
                at = m.end()
                yield at
        if at < len(text):
            yield len(text)

    def leaves(self, text: str) -> list[Leaf]:
        if self.pattern is None:
            return [Leaf(text[i : i + LEAF], min(LEAF, len(text) - i)) for i in range(0, len(text), LEAF)]
        out, low, n, end = [], 0, 0, 0
        for end in self._ends(text):
            n += 1
            if end - low >= LEAF:
                out.append(Leaf(text[low:end], n))
                low, n = end, 0
        return out + [Leaf(text[low:end], n)] if n else out

    def offset(self, text: str, rank: int) -> int:
        """Code points of a leaf's first rank units."""
        if self.pattern is None or not rank:
            return rank
        return next(end for i, end in enumerate(self._ends(text), 1) if i == rank)


class Leaf:
    """A piece of text with its counts of units and code points."""

    __slots__ = ("text", "units", "points")
    height = 0

    def __init__(self, text: str, units: int):
        self.text, self.units, self.points = text, units, len(text)


class Node:
    """Two ropes one after the other, with the sums of their counts. Heights of the two differ by one at most."""

    __slots__ = ("left", "right", "units", "points", "height")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node | None


def _even(left: Leaf | Node, right: Leaf | Node) -> Node:
    """left and right, whose heights differ by two at most, with at most one in the result."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def concat(*ropes: Rope) -> Rope:
    """The ropes in order; steps are as many as their heights differ by."""
    out = None
    for rope in ropes:
        out = rope if out is None else out if rope is None else _join(out, rope)
    return out


def _join(left: Leaf | Node, right: Leaf | Node) -> Node:
    if left.height > right.height + 1:
        return _even(left.left, _join(left.right, right))
    if right.height > left.height + 1:
        return _even(_join(left, right.left), right.right)
    return Node(left, right)


def rope_of(text: str, units: Units) -> Rope:
    """A balanced rope of a text; None if it is empty."""
    level = units.leaves(text)
    while len(level) > 1:
        level = [Node(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        if len(level) > 1 and level[-1].height < level[-2].height - 1:
            level[-2:] = [_join(level[-2], level[-1])]
    return level[0] if level else None


def split(rope: Rope, rank: int, units: Units) -> tuple[Rope, Rope]:
    """The first rank units of a rope, and the rest; only the nodes on the way to that place are made anew."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= rope.units:
        return rope, None
    if isinstance(rope, Leaf):
        at = units.offset(rope.text, rank)
        return Leaf(rope.text[:at], rank), Leaf(rope.text[at:], rope.units - rank)
    if rank < rope.left.units:
        low, high = split(rope.left, rank, units)
        return low, concat(high, rope.right)
    low, high = split(rope.right, rank - rope.left.units, units)
    return concat(rope.left, low), high


def text_of(rope: Rope) -> str:
    out, stack = [], [rope] if rope else []
    while stack:
        node = stack.pop()
        if isinstance(node, Leaf):
            out.append(node.text)
        else:
            stack += (node.right, node.left)
    return "".join(out)


_POINTS = Units()


def rearranged(rope: Rope, first: int, second: int, spm: bool, units: Units) -> tuple[Rope, Rope, Rope]:
    """(output, prefix, middle) of a rope split after `first` and `second` units; output has the suffix or the prefix in front."""
    prefix, rest = split(rope, first, units)
    middle, suffix = split(rest, second - first, units)
    sign = {s: Leaf(s, 1) for s in (PREFIX, SUFFIX, MIDDLE)}
    front = (sign[SUFFIX], suffix, sign[PREFIX], prefix) if spm else (sign[PREFIX], prefix, sign[SUFFIX], suffix)
    return concat(*front, sign[MIDDLE], middle), prefix, middle


def restored(output: str, form: str) -> str:
    """The text that `rearranged` has made output from: the rope of output is split at its sentinels."""
    if form == "plain":
        return output
    rope = rope_of(output, _POINTS)
    # Texts that hold a sentinel stay plain, so each occurs once; and none overlaps itself or another.
    parts = {}
    for sign in (MIDDLE, *((PREFIX, SUFFIX) if form == "spm" else (SUFFIX, PREFIX))):
        rope, tail = split(rope, output.index(sign), _POINTS)
        parts[sign] = split(tail, len(sign), _POINTS)[1]
    return text_of(concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


_ADDED = T.StructType([T.StructField(c, k) for c, k in (("units", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))])


def fill_in_middle(docs: DataFrame, pattern: str | None = None, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text, ..) with units (their number), form, prefix_chars and middle_chars, and output, the text in that form.

    Four numbers of a row are the first groups of 8 hexadecimal digits of the SHA-256 of seed, a colon and doc_id; so
    equal ids have equal numbers, and a null id counts as an empty string. The first two, each modulo units + 1, are
    the ranks of the cuts. form is plain if the third modulo 100 is `changed` or more, if the text is empty or null,
    or if it holds a sentinel; then output is the text, null as an empty one, and the two lengths are null. Else it
    is spm if the fourth modulo 100 is below `suffix_first`, and psm if not. Units are code points, or those of
    `pattern` (see Units). Columns named like results are replaced, repeated rows stay, nothing is shuffled.
    """
    names = _ADDED.fieldNames()
    docs = bounded(docs).drop(*names)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    own, key = docs.columns, fresh(docs, "_numbers")
    numbers = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])

    def run(batches):
        units = Units(pattern)
        for rows, _, _ in blocks(batches):
            made = []
            for text, (h1, h2, h3, h4) in zip(rows.column("text").to_pylist(), rows.column(key).to_pylist()):
                rope = rope_of(text, units) if text else None
                n = rope.units if rope else 0
                if not text or h3 % 100 >= changed or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    made.append((n, "plain", None, None, text or ""))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                form = "spm" if h4 % 100 < suffix_first else "psm"
                out, prefix, middle = rearranged(rope, first, second, form == "spm", units)
                made.append((n, form, prefix.points if prefix else 0, middle.points if middle else 0, text_of(out)))
            added = [pa.array(x, k) for x, k in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), *added], names=[*own, *names])

    return docs.withColumn(key, numbers).mapInArrow(run, T.StructType(docs.schema.fields + _ADDED.fields))


def restore(made: DataFrame) -> DataFrame:
    """made (output, form, ..) with restored, the text that output was made from; a null output counts as empty, a null form as plain."""
    made = bounded(made).drop("restored")
    own = made.columns

    def run(batches):
        for rows, _, _ in blocks(batches, "output"):
            texts = [restored(o or "", f or "plain") for o, f in zip(rows.column("output").to_pylist(), rows.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), pa.array(texts, pa.string())], names=[*own, "restored"])

    return made.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())]))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = restore(fill_in_middle(docs).drop("text"))
    return back.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, n, h, [CAST('0x' || h[1 + 8 * i : 8 + 8 * i] AS BIGINT) for i in range(4)] AS k FROM d
), c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR k[3] % 100 >= {CHANGED} OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') THEN 'plain'
              WHEN k[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
              ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
