"""Chat formatting: a small sandboxed template language, compiled to closures that stream a conversation's parts.

The language has text, `{{ expression }}`, `{% for name in messages %}`, `{% if %}` / `{% elif %}` / `{% else %}`,
`{% set name = expression %}` and `{% generation %}` around what a model is to learn. Expressions know strings,
integers, true, false, none, fields by name (`message.role`, `message['role']`), `loop.first`, `loop.index0`,
`==`, `!=`, `in`, `and`, `or`, `not`, `+` and `~` to join, and the filters escape, trim, upper and lower.
Nothing else can be reached: no calls, no attributes of Python objects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import bounded

#: Strings that mark turns here or in common chat formats. Each begins with a character that stands nowhere else in any.
CONTROLS = ("<|role|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for message in messages %}<|role|>{{ message.role | escape }}<|text|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|end|>{{ '\\n' }}{% endfor %}"
)


class Escaper:
    """Makes control strings harmless and back: each gets one more backslash after its first character."""

    def __init__(self, controls=CONTROLS):
        heads = {c[0] for c in controls}
        if any(set(c[1:]) & (heads | {"\\"}) for c in controls) or "\\" in heads:
            raise ValueError("a control string holds a first character, or a backslash, beyond its start")
        self.controls = tuple(controls)
        body = "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in controls)
        self._escape = re.compile(body)
        self._unescape = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in controls))
        self.split = re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True)))).split

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][0], text)


_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|[|.\[\]()+~=]))")
_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """A template that the language does not know."""


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        at = m.end()
        if m["name"] is not None:
            out.append(("name", m["name"]))
        elif m["int"] is not None:
            out.append(("value", int(m["int"])))
        elif m["string"] is not None:
            out.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m["string"][1:-1], flags=re.S)))
        else:
            out.append(("op", m["op"]))
    return [*out, ("end", "")]


class _Expressions:
    """Precedence climbing over one token list; nodes are tuples that start with their kind."""

    BINARY = {"or": 1, "and": 2, "==": 3, "!=": 3, "in": 3, "+": 4, "~": 4}

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self):
        return self.tokens[self.at]

    def expect(self, text: str):
        if self.next()[1] != text:
            raise TemplateError(f"expected {text!r}")

    def whole(self):
        node = self.climb(1)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def climb(self, least: int):
        if self.peek() == ("name", "not"):
            self.next()
            node = ("not", self.climb(3))
        else:
            node = self.postfix()
        while self.peek()[0] in ("name", "op") and (power := self.BINARY.get(self.peek()[1], 0)) >= least:
            op = self.next()[1]
            node = (op, node, self.climb(power + 1))
        return node

    def postfix(self):
        kind, value = self.next()
        if kind == "value":
            node = ("value", value)
        elif (kind, value) == ("op", "("):
            node = self.climb(1)
            self.expect(")")
        elif kind == "name" and value in ("true", "false", "none"):
            node = ("value", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and value not in self.BINARY:
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek()[0] == "op" and self.peek()[1] in (".", "[", "|"):
            op = self.next()[1]
            if op == "[":
                node = ("field", node, self.climb(1))
                self.expect("]")
                continue
            kind, name = self.next()
            if kind != "name":
                raise TemplateError(f"expected a name, not {name!r}")
            node = ("field", node, ("value", name)) if op == "." else ("filter", node, name)
        return node


def _parse(source: str) -> list[tuple]:
    """The syntax tree: lists of ("text", s), ("show", e), ("set", name, e), ("for", name, e, body), ("if", [(e, body)]), ("generation", body)."""
    root: list[tuple] = []
    stack: list[tuple[str, list]] = [("", root)]
    at = 0
    for m in [*_PART.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        body = stack[-1][1]
        if text:
            body.append(("text", text))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            body.append(("show", _Expressions(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            head = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not head:
                raise TemplateError(f"cannot read {m[0]!r}")
            inner: list[tuple] = []
            body.append(("for", head[1], _Expressions(head[2]).whole(), inner))
            stack.append(("for", inner))
        elif word == "if":
            inner = []
            branches = [(_Expressions(rest).whole(), inner)]
            body.append(("if", branches))
            stack.append(("if", inner))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} without if")
            stack.pop()
            inner = []
            stack[-1][1][-1][1].append((_Expressions(rest).whole() if word == "elif" else ("value", True), inner))
            stack.append(("if", inner))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                raise TemplateError(f"cannot read {m[0]!r}")
            body.append(("set", name.strip(), _Expressions(value).whole()))
        elif word == "generation":
            inner = []
            body.append(("generation", inner))
            stack.append(("generation", inner))
        elif word in ("endfor", "endif", "endgeneration"):
            if stack[-1][0] != word[3:]:
                raise TemplateError(f"unexpected {word}")
            stack.pop()
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


def _text(value) -> str:
    return "" if value is None else str(value)


def _field(value, key):
    return value.get(key) if isinstance(value, dict) else None


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: b is not None and a in b if isinstance(b, (str, dict)) and isinstance(a, str) else False,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
}


class Compiler:
    """Folds constants in the tree and turns it into closures. Rendered parts are (text, learn)."""

    def __init__(self, escaper: Escaper):
        self.filters = {"escape": lambda x: escaper.escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower()}

    def fold(self, node):
        kind = node[0]
        if kind in ("value", "name"):
            return node
        if kind == "filter":
            inner = self.fold(node[1])
            if node[2] not in self.filters:
                raise TemplateError(f"unknown filter {node[2]!r}")
            return ("value", self.filters[node[2]](inner[1])) if inner[0] == "value" else ("filter", inner, node[2])
        parts = [self.fold(x) for x in node[1:]]
        if kind in ("and", "or") and parts[0][0] == "value":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        if all(p[0] == "value" for p in parts):
            return ("value", self.expression((kind, *parts))({}))
        return (kind, *parts)

    def expression(self, node) -> Callable[[dict], object]:
        kind = node[0]
        if kind == "value":
            return lambda _, v=node[1]: v
        if kind == "name":
            return lambda scope, n=node[1]: scope.get(n)
        if kind == "filter":
            return lambda scope, f=self.filters[node[2]], a=self.expression(node[1]): f(a(scope))
        a = self.expression(node[1])
        if kind == "not":
            return lambda scope: not a(scope)
        b = self.expression(node[2])
        if kind == "and":
            return lambda scope: a(scope) and b(scope)
        if kind == "or":
            return lambda scope: a(scope) or b(scope)
        if kind == "field":
            return lambda scope: _field(a(scope), b(scope))
        return lambda scope, f=_BINARY[kind]: f(a(scope), b(scope))

    def folded(self, body: list[tuple]) -> list[tuple]:
        """Constant shows become text, constant branches are chosen, and texts that meet are joined."""
        out: list[tuple] = []
        for node in body:
            kind = node[0]
            if kind == "show":
                e = self.fold(node[1])
                node = ("text", _text(e[1])) if e[0] == "value" else ("show", e)
            elif kind == "set":
                node = ("set", node[1], self.fold(node[2]))
            elif kind == "for":
                node = ("for", node[1], self.fold(node[2]), self.folded(node[3]))
            elif kind == "generation":
                node = ("generation", self.folded(node[1]))
            elif kind == "if":
                branches = []
                for e, inner in node[1]:
                    e = self.fold(e)
                    if e[0] == "value" and not e[1]:
                        continue
                    branches.append((e, self.folded(inner)))
                    if e[0] == "value":
                        break
                if not branches or branches[0][0][0] == "value":
                    for x in branches[0][1] if branches else ():
                        out.append(x)
                    continue
                node = ("if", branches)
            if node[0] == "text" and out and out[-1][0] == "text":
                node = ("text", out.pop()[1] + node[1])
            if node != ("text", ""):
                out.append(node)
        return out

    def body(self, nodes: list[tuple]) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
        steps = [self.step(x) for x in nodes]

        def run(scope, learn):
            for step in steps:
                yield from step(scope, learn)

        return run

    def step(self, node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
        kind = node[0]
        if kind == "text":
            return lambda scope, learn, t=node[1]: iter(((t, learn),))
        if kind == "show":
            return lambda scope, learn, e=self.expression(node[1]): iter(((_text(e(scope)), learn),))
        if kind == "set":

            def put(scope, learn, name=node[1], e=self.expression(node[2])):
                scope[name] = e(scope)
                return iter(())

            return put
        if kind == "generation":
            return lambda scope, learn, b=self.body(node[1]): b(scope, True)
        if kind == "if":
            branches = [(self.expression(e), self.body(inner)) for e, inner in node[1]]

            def choose(scope, learn):
                for test, inner in branches:
                    if test(scope):
                        return inner(scope, learn)
                return iter(())

            return choose
        name, over, inner = node[1], self.expression(node[2]), self.body(node[3])

        def loop(scope, learn):
            for i, x in enumerate(over(scope) or ()):
                yield from inner(scope | {name: x, "loop": {"first": i == 0, "index0": i}}, learn)

        return loop


@dataclass
class Template:
    """A compiled template. `parts` renders messages, which may be any iterator, without holding them."""

    source: str = TEMPLATE
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        self.escaper = Escaper(self.controls)
        compiler = Compiler(self.escaper)
        self.tree = compiler.folded(_parse(self.source))
        self._run = compiler.body(self.tree)

    def parts(self, messages, **values) -> Iterator[tuple[str, bool]]:
        return self._run({**values, "messages": messages}, False)

    def render(self, messages, **values) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans under the loss mask."""
        out, spans, at = [], [], 0
        for text, learn in self.parts(messages, **values):
            if learn:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


#: Code points of a formatted piece beyond which the next one begins.
PIECE = 1 << 18
_PIECES = "conv_id long, piece long, text string, learn array<struct<start:int,end:int>>"


def _sorted(conversations: DataFrame) -> DataFrame:
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bounded(conversations).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, source: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """(conv_id, piece, text, learn): each conversation's formatted text in pieces, with the spans to learn.

    conversations has a row a turn: conv_id, turn, role, text. Turns are ordered by turn (null first), then role
    and text; null roles and texts are empty, repeated rows are turns of their own, a null conv_id is a
    conversation of its own, and further columns play no part. Pieces are in order within the partition, end
    where a part of the template ends, and exceed `piece` code points by a single turn at most. A conversation is streamed, so its length costs no memory.
    """
    Template(source)  # fails here rather than in a task

    def run(batches):
        template = Template(source)

        def rows():
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        stream = rows()
        ahead = next(stream, None)
        done: list[tuple[int | None, int, str, list[dict]]] = []
        weight = 0
        while ahead is not None:
            conv = ahead[0]

            def messages():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    yield {"role": ahead[1], "text": ahead[2]}
                    ahead = next(stream, None)

            texts, spans, at, number = [], [], 0, 0
            for text, learn in template.parts(messages()):
                if learn:
                    spans.append({"start": at, "end": at + len(text)})
                texts.append(text)
                at += len(text)
                if at >= piece:
                    done.append((conv, number, "".join(texts), spans))
                    weight += at
                    texts, spans, at, number = [], [], 0, number + 1
                    if weight >= 4 * piece:
                        yield _pieces(done)
                        done, weight = [], 0
            if texts or not number:
                done.append((conv, number, "".join(texts), spans))
                weight += at
            for _ in messages():  # what a template without a loop has left
                pass
            if weight >= 4 * piece or len(done) >= 1000:
                yield _pieces(done)
                done, weight = [], 0
        if done:
            yield _pieces(done)

    return _sorted(conversations).mapInArrow(run, _PIECES)


def _pieces(rows) -> pa.RecordBatch:
    conv, piece, text, learn = zip(*rows)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(text, pa.string()), pa.array(learn, kind)], names=["conv_id", "piece", "text", "learn"])


class _Reader:
    """Reads turns back from pieces of one conversation formatted by TEMPLATE."""

    def __init__(self, escaper: Escaper):
        self.escaper = escaper
        self.turns, self.loss, self.n, self.loss_chars, self.chars, self.open = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""

    def add(self, text: str, learn) -> None:
        self.chars += len(text)
        for span in learn:
            own = self.escaper.unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        *turns, self.open = (self.open + text).split("<|end|>")
        for turn in turns:
            head, _, body = turn.partition("<|text|>")
            _, _, role = head.partition("<|role|>")
            self.turns.update(f"{self.escaper.unescape(role)}\n{self.escaper.unescape(body)}\n".encode())
            self.n += 1


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """What `format_conversations` with its own template has put into pieces, a row for each conversation.

    pieces must still be in the partitions and the order in which they were made.
    """

    def run(batches):
        escaper = Escaper()
        conv, reader, out = None, None, []

        def closed():
            out.append((conv, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[f.split()[0] for f in _READ.split(", ")])

        for batch in batches:
            for i, number, text, learn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "text", "learn"))):
                if not number:
                    if reader:
                        closed()
                    conv, reader = i, _Reader(escaper)
                reader.add(text, learn)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if reader:
            closed()
        if out:
            yield batch_of(out)

    return pieces.mapInArrow(run, _READ)


_EXTRA = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _EXTRA), (-7, 1, "assistant", _EXTRA)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(given.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         -- Each control string, escaped already or not, grows by one backslash.
         length(role) + length(text) + 24
         + len(regexp_extract_all(role, '<\\*(\|role\|>|\|text\|>|\|end\|>|s>|/s>)|\[\\*(INST\]|/INST\])'))
         + len(regexp_extract_all(text, '<\\*(\|role\|>|\|text\|>|\|end\|>|s>|/s>)|\[\\*(INST\]|/INST\])')) AS formatted
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
