"""Conversation structure repair: rows as an input acceptor, composed lazily with an edit transducer and a role grammar; shortest paths over (cost, labels).

The composition has a state (row, inserts since the last row, grammar state), and weights are a cost and the string of
edit labels, compared in that order. Its inserts are layered: no shortest path has more than two between two rows, as
a third would come back to a grammar state. So it has no cycle, and shortest distances to the end are found from the
last row to the first. Labels are put before a string, which keeps the order of strings; and no two edits of a state
have one label. So among equal costs the label alone decides, and no string is ever compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Tables, bounded, cut

#: Costs of edits; of keeping or reroling a row that ends without a stop; a blank or duplicate row is always deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: The grammar (s?(ua)+)?: what follows each state on a role's initial. 0 is the start; 0 and 3 are final.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ROLES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
#: Rows of a conversation that one block holds.
BLOCK = 1 << 16

# A row as a symbol of the input acceptor, one byte: the place of its role's initial, and whether it lacks a stop or has to go.
_INITIALS = "sua?"
_OPEN, _GONE = 4, 8


class Composition:
    """Arcs of the composition, made when they are first asked for.

    A vector has the cost to the end for each grammar state, less the smallest of them; as few vectors occur, each
    (vector, symbol) is worked out once.
    """

    def __init__(self):
        self._known: dict[tuple, tuple] = {}
        # Inserts that lead from each state to the end, behind the last row.
        self.tails = ["", "II", "I", ""]
        self.end = tuple(INSERT * len(t) for t in self.tails)

    def _arcs(self, state: int, code: int, inserts: int):
        """(label, weight, state after, whether a row is read) of one state of the composition."""
        initial, gone, open_end = code & 3, bool(code & _GONE), bool(code & _OPEN)
        yield "D", DELETE, state, True
        if not gone:
            extra = TRUNCATED if open_end else 0
            after = GRAMMAR[state].get(_INITIALS[initial])
            if after is not None:
                yield "K", KEEP + extra, after, True
            for role in "ua":
                if role in GRAMMAR[state]:
                    yield "R", REROLE + extra, GRAMMAR[state][role], True
        if inserts < 2:
            for role in "ua":
                if role in GRAMMAR[state]:
                    yield "I", INSERT, GRAMMAR[state][role], False

    def back(self, vector: tuple, code: int) -> tuple[tuple, int, tuple]:
        """(vector before the row, what has been taken off it, (edits, state after) for each state) from the vector behind it."""
        key = vector, code
        if key not in self._known:
            best = [[None] * 4 for _ in range(3)]
            for inserts in (2, 1, 0):
                for state in range(4):
                    ways = []
                    for label, weight, after, read in self._arcs(state, code, inserts):
                        cost, edits, then = (vector[after], "", after) if read else best[inserts + 1][after]
                        ways.append((cost + weight, label, edits, then))
                    cost, label, edits, then = min(ways)
                    best[inserts][state] = cost, label + edits, then
            least = min(c for c, _, _ in best[0])
            self._known[key] = tuple(min(c - least, _FAR) for c, _, _ in best[0]), least, tuple((e, s) for _, e, s in best[0])
        return self._known[key]

    def solve(self, codes: bytes, vector: tuple) -> tuple[tuple, int, list[tuple]]:
        """(vector before all rows, what has been taken off it, the choices at each row) from the vector behind the last."""
        total, choices = 0, []
        for code in reversed(codes):
            vector, off, chosen = self.back(vector, code)
            total += off
            choices.append(chosen)
        choices.reverse()
        return vector, total, choices

    def matrix(self, codes: bytes) -> list[int]:
        """Least costs over the rows from each state (before) to each state (behind), row by row."""
        columns = []
        for state in range(4):
            vector, off, _ = self.solve(codes, tuple(0 if s == state else _FAR for s in range(4)))
            columns.append([min(c + off, _FAR) for c in vector])
        return [columns[b][a] for a in range(4) for b in range(4)]

    @staticmethod
    def walk(choices: list[tuple], state: int) -> tuple[list[str], int]:
        """The edits of each row from a state on, and the state behind the last."""
        out = []
        for chosen in choices:
            edits, state = chosen[state]
            out.append(edits)
        return out, state


# Rows and their faults

_SPACE = " \t\n\x0b\f\r"
_KEY = ("conv_id", "known", "at", "digest")


def _rows(conversations: DataFrame, copies: str | None) -> DataFrame:
    """(conv_id, turn, known, at, role, text, digest, copies) of turns; a null role or text is one space.

    known and at order turns, null first; copies is how many rows of the kind there are, from the column of that name or 1.
    """
    one = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    many = (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies")
    rows = bounded(conversations).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one("role"), one("text"), many)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role", "text", digest.alias("digest"), "copies")


def faults(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, known, at, digest, initial, blank, later, open_end, copies): each distinct row of each conversation with what is wrong with it.

    conversations has conv_id, turn, role, text, and perhaps a column that says how many copies of a row there are.
    Rows are ordered by turn (null first), those of a turn by the digest of role and text; equal rows of a turn are one
    here, with their number in copies. blank: nothing but white space. later: role and text stand at an earlier turn
    too. open_end: the last character that is no white space is none of `.!?`. Of equal rows of a turn all but the
    first are duplicates.
    """
    # Empty conversations have rows of no copies, to keep their ids.
    rows = _rows(conversations, copies).filter("copies > 0")
    body = F.rtrim("text", F.lit(_SPACE))
    marks = [F.left("role", F.lit(1)).alias("initial"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("open_end")]
    narrow = rows.select(*_KEY, *marks, "copies").groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in ("initial", "blank", "open_end")], F.sum("copies").alias("copies"))
    turn = F.struct("known", "at")
    again = narrow.filter("not blank").groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = F.col("first").isNotNull() & ~F.col("blank") & (turn != F.col("first"))
    return narrow.join(again, same, "left").select(*_KEY, "initial", "blank", F.coalesce(later, F.lit(False)).alias("later"), "open_end", "copies")


_MARKS = ("initial", "blank", "later", "open_end", "copies")
_ROW = "known boolean, at long, digest binary, initial string, blank boolean, later boolean, open_end boolean, copies long"
_CHOSEN = f"conv_id long, {_ROW}, edits string"
_PARTED = f"{_CHOSEN}, part int, block int"


def _codes(row: tuple) -> bytes:
    """Symbols of a row (_ROW) and its copies, all but the first of which have to go."""
    initial, blank, later, open_end, copies = row[3:8]
    place = _INITIALS.find(initial) if initial in ("s", "u", "a") else 3
    return bytes([place + _OPEN * open_end + _GONE * (blank or later)]) + bytes([place + _GONE]) * (copies - 1)


def _solved(composition: Composition, rows: list[tuple], vector: tuple, state: int, last: bool) -> list[str]:
    """The edits of each row, those of its copies joined, inserts behind the last row with them."""
    sizes = [row[7] for row in rows]
    edits, state = composition.walk(composition.solve(b"".join(map(_codes, rows)), vector)[2], state)
    out, at = [], 0
    for n in sizes:
        out.append("".join(edits[at : at + n]))
        at += n
    if last:
        out[-1] += composition.tails[state]
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_ARROW_ROW = [("known", pa.bool_()), ("at", pa.int64()), ("digest", pa.binary()), ("initial", pa.string()), ("blank", pa.bool_()), ("later", pa.bool_()), ("open_end", pa.bool_()), ("copies", pa.int64())]
_ARROW_PARTED = pa.schema([("conv_id", pa.int64()), *_ARROW_ROW, ("edits", pa.string()), ("part", pa.int32()), ("block", pa.int32())])


def _tuples(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _parted(size: int):
    """Sorted rows to _PARTED: with edits where a conversation lies inside a partition and has `size` symbols or fewer, else with part and block."""

    def run(batches):
        composition, part, block = Composition(), TaskContext.get().partitionId(), 0
        stream, done = _tuples(batches, "conv_id", *_KEY[1:], *_MARKS), []
        held, weight, opened, first = [], 0, False, True
        ahead = next(stream, None)
        while ahead is not None:
            held.append(ahead[1:])
            weight += ahead[8]
            conv, ahead = ahead[0], next(stream, None)
            ends = ahead is None or ahead[0] != conv
            if not ends and weight < size:
                continue
            # The first and the last conversation of a partition may go on in another.
            if first or opened or not ends or ahead is None:
                done += [(conv, *row, None, part, block) for row in held]
                block += 1
            else:
                done += [(conv, *row, e, None, None) for row, e in zip(held, _solved(composition, held, composition.end, 0, True))]
            opened, first = not ends, first and not ends
            held, weight = [], 0
            if len(done) >= 4096:
                yield _table(done, _ARROW_PARTED)
                done = []
        if done:
            yield _table(done, _ARROW_PARTED)

    return run


def _blocks(batches) -> Iterator[tuple]:
    """(conv_id, part, block, extra columns' values, rows) of sorted rows of blocks, where extra columns are those after block."""
    held, key, more = [], None, ()
    for conv, *row in _tuples(batches, "conv_id", *[n for n, _ in _ARROW_ROW], "part", "block"):
        if key is not None and (row[8], row[9]) != key[1:]:
            yield (*key, held)
            held = []
        key = conv, row[8], row[9]
        held.append(tuple(row[:8]))
    if key is not None:
        yield (*key, held)


_BLOCK = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32())])
_VECTOR = pa.list_(pa.int64())


def _in_blocks(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part", "block").sortWithinPartitions("part", "block", "known", "at", "digest")


def _scanned(summaries: DataFrame, column: str, fold, kinds: pa.Schema, schema: str) -> DataFrame:
    """fold(list of (part, block, column's value) of one conversation, in order) for each conversation: one short row for each block of it."""

    def run(batches):
        for batch in batches:
            for row in batch.column("all").to_pylist():
                yield _table(fold([(x["part"], x["block"], x[column]) for x in row]), kinds)

    grouped = summaries.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", column))).alias("all"))
    return grouped.select("all").mapInArrow(run, schema)


def _across_blocks(rows: DataFrame, tables: Tables, parts: int) -> DataFrame:
    """_CHOSEN for rows (_PARTED) of conversations that lie in several blocks.

    Each block is a matrix of least costs between grammar states; multiplied from the last block to the first they give
    the costs to the end behind each block, and with these a block makes its choices alone. They lead from each
    state before it to one behind it; followed from the first block on, these give the state in which a block begins.
    """

    def coded(batches):
        composition = Composition()
        for conv, part, block, held in _blocks(batches):
            codes = b"".join(map(_codes, held))
            yield _table([(conv, part, block, codes, composition.matrix(codes))], pa.schema([*_BLOCK, ("codes", pa.binary()), ("matrix", _VECTOR)]))

    def ends(blocks):
        vector, out = Composition().end, []
        for i, (part, block, m) in enumerate(reversed(blocks)):
            out.append((part, block, list(vector), i == 0))
            vector = [min(m[4 * a + b] + vector[b] for b in range(4)) for a in range(4)]
        return out

    def exits(batches):
        composition = Composition()
        for conv, part, block, codes, vector in _tuples(batches, "conv_id", "part", "block", "codes", "vector"):
            choices = composition.solve(codes, _levelled(vector))[2]
            yield _table([(conv, part, block, [composition.walk(choices, s)[1] for s in range(4)])], pa.schema([*_BLOCK, ("exits", pa.list_(pa.int32()))]))

    def starts(blocks):
        state, out = 0, []
        for part, block, after in blocks:
            out.append((part, block, state))
            state = after[state]
        return out

    def chosen(batches):
        composition, held, key = Composition(), [], None

        def made():
            conv, _, _, vector, last, state = key
            return _table([(conv, *row, e) for row, e in zip(held, _solved(composition, held, _levelled(vector), state, last))], pa.schema(list(_ARROW_PARTED)[:10]))

        for conv, *row in _tuples(batches, "conv_id", *[n for n, _ in _ARROW_ROW], "part", "block", "vector", "last", "state"):
            now = (conv, *row[8:])
            if key is not None and now[1:3] != key[1:3]:
                yield made()
                held = []
            key = now
            held.append(tuple(row[:8]))
        if key is not None:
            yield made()

    own = "part int, block int"
    blocks = tables.cut(_in_blocks(rows, parts).mapInArrow(coded, f"conv_id long, {own}, codes binary, matrix array<bigint>"))
    kinds = pa.schema([*list(_BLOCK)[1:], ("vector", _VECTOR), ("last", pa.bool_())])
    vectors = tables.cut(_scanned(blocks, "matrix", ends, kinds, f"{own}, vector array<bigint>, last boolean"))
    led = blocks.join(vectors, ["part", "block"]).mapInArrow(exits, f"conv_id long, {own}, exits array<int>")
    begun = tables.cut(_scanned(led, "exits", starts, pa.schema([*list(_BLOCK)[1:], ("state", pa.int32())]), f"{own}, state int"))
    return _in_blocks(rows.join(vectors, ["part", "block"]).join(begun, ["part", "block"]), parts).mapInArrow(chosen, _CHOSEN)


def _levelled(vector) -> tuple:
    return tuple(v - min(vector) for v in vector)


def repairs(conversations: DataFrame, tables: Tables, copies: str | None = None, block: int = BLOCK) -> DataFrame:
    """`faults` with edits: for each row and its copies the labels K (keep), R (rerole), D (delete) and I (insert before it, behind the last row after it).

    They are the cheapest that leave roles whose initials are `(s?(ua)+)?`, and of those the least string. Rows are
    sorted over all partitions by ranges, so no conversation has to be in one task; see _across_blocks. The table is written.
    """
    rows = tables.cut(faults(conversations, copies))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tables.cut(rows.repartitionByRange(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_parted(block), _PARTED))
    tables.drop(rows)
    columns = [n.split(" ")[0] for n in _CHOSEN.split(", ")]
    opened = tables.cut(_across_blocks(found.filter("part is not null"), tables, parts))
    return found.filter("part is null").select(*columns).unionByName(opened)


# Repaired conversations


class _Repaired:
    """The turns of one conversation after its edits, in order, and what there is to report."""

    def __init__(self):
        self.state = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = self.before = None
        self.audit: list[str] = []

    def note(self, row: tuple) -> None:
        known, at, _, initial, blank, later, open_end, copies = row
        if known:
            self.low, self.high = at if self.low is None else self.low, at
            self.turns += self.last != at
            self.last = at
        self.illegal += (self.before is not None and self.before + initial not in ("su", "ua", "au")) + copies - 1
        self.before = initial
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not later)
            self.truncated += bool(not later and open_end)

    def edited(self, row: tuple, edits: str, texts) -> Iterator[tuple[str, str]]:
        """Turns (role, text) that come of a row's edits; texts is asked for the row's own (role, text) if it stays."""
        self.note(row)
        self.audit.append(edits)
        for label in edits:
            if label == "D":
                self.cost += DELETE
                continue
            own = ("", "") if label == "I" else texts()
            initial = own[0][:1] if label == "K" else "a" if self.state == 2 else "u"
            self.state = GRAMMAR[self.state][initial]
            self.cost += INSERT if label == "I" else (REROLE if label == "R" else KEEP) + (TRUNCATED if row[6] else 0)
            yield own if label == "K" else (_ROLES[initial], own[1])

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit)


def _merged(conversations: DataFrame, edits: DataFrame, copies: str | None) -> DataFrame:
    """Rows of edits, each followed by the turns that it is about (which = 1), and rows of no copies (which = 2), sorted within conversations."""
    rows = _rows(conversations, copies)
    blank = F.rtrim("text", F.lit(_SPACE)) == ""
    kind = F.when(F.col("copies") == 0, 2).otherwise(1)
    # Blank rows are always deleted, so their texts stay where they are.
    turns = rows.filter((F.col("copies") == 0) | ~blank).select(*_KEY, kind.alias("which"), F.when(kind == 1, F.col("role")).alias("role"), F.when(kind == 1, F.col("text")).alias("text"))
    both = edits.withColumn("which", F.lit(0)).unionByName(turns, allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "conv_id").sortWithinPartitions(*_KEY, "which")


class _Stream:
    """Goes through what `_merged` has sorted, conversation by conversation, without holding one."""

    def __init__(self, batches):
        self._rows = _tuples(batches, "conv_id", "which", *[n for n, _ in _ARROW_ROW], "edits", "role", "text")
        self.ahead = next(self._rows, None)

    def conversations(self) -> Iterator[tuple[int | None, _Repaired, Iterator[tuple[str, str]]]]:
        while self.ahead is not None:
            conv, made = self.ahead[0], _Repaired()
            turns = self._turns(conv, made)
            yield conv, made, turns
            for _ in turns:
                pass

    def _turns(self, conv, made: _Repaired) -> Iterator[tuple[str, str]]:
        own = None

        def texts():
            nonlocal own
            if own is None:  # the first turn behind the row of its edits
                own = self.ahead[11:13]
            return own

        while self.ahead is not None and self.ahead[0] == conv:
            row = self.ahead
            self.ahead = next(self._rows, None)
            if row[1] == 0:
                own = None
                yield from made.edited(row[2:10], row[10], texts)


def repaired(conversations: DataFrame, copies: str | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation after its edits; see `repairs`. Conversations without any are left out.

    Null turns come first, a null role or text is one space, a null conv_id is a conversation of its own, equal rows of
    a turn are duplicates but for one, and further columns play no part.
    """

    def run(batches):
        for conv, _, turns in _Stream(batches).conversations():
            done, weight, at = [], 0, 0
            for pos, (role, text) in enumerate(turns):
                done.append((conv, pos, role, text))
                weight += len(text)
                if weight >= 1 << 20 or len(done) >= 4096:
                    yield _table(done, turn)
                    done, weight = [], 0
            if done:
                yield _table(done, turn)

    turn = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    with Tables(conversations.sparkSession) as tables:
        return cut(_merged(conversations, repairs(conversations, tables, copies, block), copies).mapInArrow(run, "conv_id long, pos long, role string, text string"))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(conversations: DataFrame, copies: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each conversation: numbers of faults, cost and labels of its edits, and the SHA-256 of its repaired turns, `role:text` joined by newlines.

    gaps: turns between the first and the last that no row has. blank, duplicate, truncated: rows by their first fault.
    illegal: neighbouring rows whose roles' initials are none of su, ua and au. A conversation whose rows all have
    no copies has zeros, no label and the digest of an empty text. See `repaired` for odd rows. A conversation is
    streamed, so its length costs the memory of its labels only; its digest is one task's work.
    """

    def run(batches):
        done = []
        for conv, made, turns in _Stream(batches).conversations():
            digest = hashlib.sha256()
            for i, (role, text) in enumerate(turns):
                digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            done.append((conv, *made.report(), digest.hexdigest()))
            if len(done) >= 1024:
                yield _table(done, out)
                done = []
        if done:
            yield _table(done, out)

    out = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (f.split(" ") for f in _REPORT.split(", "))])
    with Tables(conversations.sparkSession) as tables:
        return cut(_merged(conversations, repairs(conversations, tables, copies, block), copies).mapInArrow(run, _REPORT))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with copies, and with rows damaged by the CRC-32 of `conv_id:turn` modulo 20; a null in any column is one space there.

    0: no copies, so the row is gone; 1: an empty text; 2: no `.`, `!` and `?` in the text; 3: two copies; 4: role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies")
