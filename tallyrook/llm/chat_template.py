"""Chat formatting by a compiled template.

The template language: text, {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %}, {% for x in xs %}/{% endfor %},
{% set x = expression %}, {% generation %}/{% endgeneration %}. Expressions: strings, integers, true, false, none, names,
item access by .name or ['name'], ==, !=, <, <=, >, >=, in, and, or, not, +, ~ (joins as strings), and filters applied
with |. It is a sandbox: names are looked up in the given variables only, items in mappings only, filters in a fixed
table, and names that begin with an underscore are refused.

compile_template() parses to a syntax tree, folds constant expressions, prunes branches with constant tests and merges
neighbouring text, then makes one Python closure a node. Closures are generators of (text, inside a generation marker),
so that a conversation of any length is rendered turn by turn, and its messages may come from an iterator.

Spark: rows are dealt by conversation and sorted by turn within partitions, and each conversation streams through the
closures and, as formatted text, through a reader that finds turns and loss spans again. At no time is more than one
turn held, so a conversation with a third of all rows needs no more memory than another; its turns are one after another, so it
is one task's time.

Null texts and roles are empty; a null conversation id is one conversation; turns with equal numbers are ordered by role
and text, null turn numbers first; repeated rows are repeated turns; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- control strings ---------------------------------------------------------------------------------------------
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that may not stand unescaped in a text: the template's own and those of other common chat formats.
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")

DEFAULT = (
    "{% for message in messages %}"
    f"{TURN}{{{{ message.role | escape }}}}{BODY}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    f"{END}\n"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Doubles the escape character and puts one after the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# --- syntax tree -------------------------------------------------------------------------------------------------
class TemplateError(ValueError):
    """The template is not in the language, or asks for what the sandbox refuses."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    id: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_show(x)),
    "trim": lambda x: _show(x).strip(),
    "lower": lambda x: _show(x).lower(),
    "upper": lambda x: _show(x).upper(),
    "length": len,
}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _show(a) + _show(b),
}
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))""")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORDS = {"true": True, "false": False, "none": None}


def _show(value: Any) -> str:
    return "" if value is None else str(value)


class _Expression:
    """A parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"no expression: {source!r}")
            self.tokens.append(next((kind, x) for kind, x in zip(("str", "int", "name", "op"), m.groups(), strict=True) if x is not None))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def whole(self) -> Any:
        found = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def take(self, *wanted: str) -> str | None:
        kind, x = self.tokens[self.at]
        if kind in ("op", "name") and x in wanted:
            self.at += 1
            return x
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r} before {self.tokens[self.at][1]!r}")

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.joined()
        while kind := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            left = Op(kind, (left, self.joined()))
        return left

    def joined(self) -> Any:
        left = self.filtered()
        while kind := self.take("+", "~"):
            left = Op(kind, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        left = self.item()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            left = Filter(name, left)
        return left

    def item(self) -> Any:
        left = self.single()
        while kind := self.take(".", "["):
            if kind == ".":
                left = Item(left, Const(self.name()))
            else:
                left = Item(left, self.either())
                self.need("]")
        return left

    def single(self) -> Any:
        kind, x = self.tokens[self.at]
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1]))
        if kind == "int":
            return Const(int(x))
        if kind == "name" and x in _WORDS:
            return Const(_WORDS[x])
        if kind == "name":
            self.at -= 1
            return Name(self.name())
        raise TemplateError(f"unexpected {x!r}")

    def name(self) -> str:
        kind, x = self.tokens[self.at]
        if kind != "name" or x in ("and", "or", "not", "in"):
            raise TemplateError(f"expected a name before {x!r}")
        if x.startswith("_"):
            raise TemplateError(f"the sandbox refuses {x!r}")
        self.at += 1
        return x


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    nodes, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            nodes.append(("text", source[at : m.start()]))
        nodes.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    nodes.append(("text", source[at:]))
    queue = iter(nodes)
    body, ended = _body(queue, ())
    assert not ended
    return body


def _body(queue: Iterator[tuple[str, str]], until: tuple[str, ...]) -> tuple[tuple, str]:
    """Nodes up to a tag that begins with one of until, and that tag."""
    found: list = []
    for kind, x in queue:
        word = x.split(None, 1)[0] if kind == "tag" and x else ""
        if kind == "text":
            found.append(Text(x))
        elif kind == "out":
            found.append(Output(_Expression(x).whole()))
        elif word in until:
            return tuple(found), x
        elif word == "if":
            found.append(_branches(queue, x[2:]))
        elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", x, re.S)):
            found.append(For(m[1], _Expression(m[2]).whole(), _body(queue, ("endfor",))[0]))
        elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(.+)", x, re.S)):
            found.append(Set(m[1], _Expression(m[2]).whole()))
        elif word == "generation":
            found.append(Generation(_body(queue, ("endgeneration",))[0]))
        else:
            raise TemplateError(f"unknown or misplaced tag {x!r}")
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(found), ""


def _branches(queue: Iterator[tuple[str, str]], test: str) -> If:
    then, ended = _body(queue, ("elif", "else", "endif"))
    if ended.startswith("elif"):
        other: tuple = (_branches(queue, ended[4:]),)
    else:
        other = _body(queue, ("endif",))[0] if ended == "else" else ()
    return If(_Expression(test).whole(), then, other)


# --- folding -----------------------------------------------------------------------------------------------------
def fold_expression(e: Any) -> Any:
    if isinstance(e, Item):
        return Item(fold_expression(e.of), fold_expression(e.key))
    if isinstance(e, Filter):
        arg = fold_expression(e.arg)
        return Const(FILTERS[e.name](arg.value)) if isinstance(arg, Const) else Filter(e.name, arg)
    if isinstance(e, Op):
        args = tuple(fold_expression(a) for a in e.args)
        if e.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
        if all(isinstance(a, Const) for a in args):
            return Const(not args[0].value if e.kind == "not" else BINARY[e.kind](*(a.value for a in args)))
        return Op(e.kind, args)
    return e


def fold(nodes: tuple) -> tuple:
    """The same template with constants computed, dead branches gone and neighbouring text merged."""
    found: list = []
    for node in nodes:
        for x in _folded(node):
            if isinstance(x, Text) and found and isinstance(found[-1], Text):
                found[-1] = Text(found[-1].value + x.value)
            elif not (isinstance(x, Text) and not x.value):
                found.append(x)
    return tuple(found)


def _folded(node: Any) -> tuple:
    if isinstance(node, Output):
        e = fold_expression(node.expr)
        return (Text(_show(e.value)),) if isinstance(e, Const) else (Output(e),)
    if isinstance(node, If):
        test, then, other = fold_expression(node.test), fold(node.then), fold(node.other)
        return (then if test.value else other) if isinstance(test, Const) else (If(test, then, other),)
    if isinstance(node, For):
        return (For(node.name, fold_expression(node.of), fold(node.body)),)
    if isinstance(node, Set):
        return (Set(node.name, fold_expression(node.expr)),)
    if isinstance(node, Generation):
        return (Generation(fold(node.body)),)
    return (node,)


# --- closures ----------------------------------------------------------------------------------------------------
Scope = dict[str, Any]
Pieces = Iterator[tuple[str, bool]]


def _value(e: Any) -> Callable[[Scope], Any]:
    if isinstance(e, Const):
        return lambda scope, value=e.value: value
    if isinstance(e, Name):
        return lambda scope, name=e.id: scope.get(name)
    if isinstance(e, Filter):
        f, arg = FILTERS[e.name], _value(e.arg)
        return lambda scope: f(arg(scope))
    if isinstance(e, Item):
        of, key = _value(e.of), _value(e.key)

        def item(scope: Scope) -> Any:
            held = of(scope)
            return held.get(key(scope)) if isinstance(held, Mapping) else None

        return item
    args = tuple(map(_value, e.args))
    if e.kind == "not":
        return lambda scope: not args[0](scope)
    if e.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = BINARY[e.kind]
    return lambda scope: f(args[0](scope), args[1](scope))


def _block(nodes: tuple, marked: bool) -> Callable[[Scope], Pieces]:
    steps = tuple(_step(n, marked) for n in nodes)

    def run(scope: Scope) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: Any, marked: bool) -> Callable[[Scope], Pieces]:
    if isinstance(node, Text):
        return lambda scope, piece=((node.value, marked),): iter(piece)
    if isinstance(node, Output):
        value = _value(node.expr)
        return lambda scope: iter(((_show(value(scope)), marked),))
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then, marked), _block(node.other, marked)
        return lambda scope: (then if test(scope) else other)(scope)
    if isinstance(node, Set):
        value = _value(node.expr)

        def put(scope: Scope) -> Pieces:
            scope[node.name] = value(scope)
            return iter(())

        return put
    of, body = _value(node.of), _block(node.body, marked)

    def loop(scope: Scope) -> Pieces:
        for i, x in enumerate(of(scope) or ()):
            yield from body(scope | {node.name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}})

    return loop


def compile_template(source: str) -> Callable[..., Pieces]:
    """A function of the template's variables that yields (text, inside a generation marker) piece by piece."""
    run = _block(fold(parse(source)), False)
    return lambda **variables: run(dict(variables))


# --- reading back ------------------------------------------------------------------------------------------------
def read_turns(pieces: Pieces) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of a conversation that DEFAULT has formatted.

    Control strings of the template split the text; what stands between is unescaped. No text contains one, so it does
    not matter where the pieces were cut.
    """
    text, mask = "", []
    for piece, marked in pieces:
        if marked:
            mask.append((len(text), len(text) + len(piece)))
        text += piece
        while (end := text.find(END)) >= 0:
            body = text.index(BODY)
            begin = text.index(TURN) + len(TURN)
            yield unescape(text[begin:body]), unescape(text[body + len(BODY) : end]), unescape("".join(text[a:b] for a, b in mask))
            text, mask = text[end + len(END) :], []


def format_conversations(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, piece, text, generation: the formatted text of each conversation, in pieces numbered from 0.

    Joined in order, a conversation's pieces are its formatted text; generation tells which are under the loss mask.
    """

    def pieces(conv_id: Any, turns: Iterable[dict]) -> Iterator[tuple]:
        for i, (text, marked) in enumerate(x for x in compile_template(template)(messages=turns) if x[0]):
            yield conv_id, i, text, marked

    return _per_conversation(conversations, pieces, "conv_id long, piece long, text string, generation boolean")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation, of what read_turns() finds in its formatted text."""

    def digest(conv_id: Any, turns: Iterable[dict]) -> Iterator[tuple]:
        formatted = 0

        def seen(pieces: Pieces) -> Pieces:
            nonlocal formatted
            for piece in pieces:
                formatted += len(piece[0])
                yield piece

        n, loss_chars, all_, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
        for role, text, learned in read_turns(seen(compile_template(DEFAULT)(messages=turns))):
            n += 1
            all_.update(f"{role}\n{text}\n".encode())
            loss_chars += len(learned)
            loss.update(learned.encode())
        yield conv_id, n, all_.hexdigest(), loss_chars, loss.hexdigest(), formatted

    return _per_conversation(conversations, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _per_conversation(conversations: DataFrame, f: Callable[[Any, Iterable[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """f over the turns of each conversation, in order; both its input and its output stream."""
    none = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), none).alias("role"), F.coalesce(F.col("text").cast("string"), none).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    target = StructType.fromDDL(schema)
    names, kinds = target.names, [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t.dataType.simpleString()] for t in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        out: list[tuple] = []
        ahead = next(flat, None)
        while ahead is not None:
            conv_id = ahead[0]

            def turns() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv_id:  # noqa: B023
                    row, ahead = ahead, next(flat, None)
                    yield {"role": row[1], "text": row[2]}

            rest = turns()
            for row in f(conv_id, rest):
                out.append(row)
                if len(out) >= 2000:
                    yield _batch(out, names, kinds)
                    out = []
            for _ in rest:  # a template need not read all turns
                pass
        if out:
            yield _batch(out, names, kinds)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sql_escape(x: str) -> str:
    pattern = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "<")
    square = "|".join(c[1:].replace("]", r"\]") for c in sorted(CONTROL, key=len, reverse=True) if c[0] == "[")
    doubled = rf"replace({x}, '\', '\\')"
    return rf"regexp_replace(regexp_replace({doubled}, '<({pattern})', '<\\\1', 'g'), '\[({square})', '[\\\1', 'g')"


CONVERSATION_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END) + 1} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
