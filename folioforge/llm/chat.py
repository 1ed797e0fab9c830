"""Chat formatting by a template compiler.

A template in a small sandboxed language is parsed into a syntax tree, constants are folded, and each node becomes a
Python closure that writes into a sink. The sink keeps the text and the spans that generation markers cover.

The language: `{{ expression }}`; `{% for x in e %}`, `{% if e %}` / `{% elif e %}` / `{% else %}`, `{% set x = e %}`,
`{% generation %}`, each with its end tag; `-` next to a brace strips white space there. Expressions: strings, integers,
true/false/none, names, `a.key`, `a["key"]`, `a[0]`, `==`, `!=`, `in`, `and`, `or`, `not`, `~` (joins as text), `+`,
`x if c else y`, and filters after `|`. Sandbox: there are no calls, `.` and `[]` reach only into mappings and lists,
names starting with `_` are refused, and filters come from a fixed list.

Rows of `conversations`: turns go by (turn, role, text), nulls first; a null text or role is empty; rows with a null
conv_id form one conversation; repeated rows are turns of their own; extra columns are dropped; an empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches

TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", "</turn>\n"

#: Every turn is `### role: text</turn>`; what an assistant says is marked as generated.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape_text }}{% endgeneration %}"
    "{% else %}{{ m.content | escape_text }}{% endif %}</turn>\n{% endfor %}"
)

_TEXT_ESCAPE = re.compile(r"[\\#<]")
_ROLE_ESCAPE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape_text(s: str) -> str:
    """A backslash before every backslash, # and <, so that no control string is left in a text."""
    return _TEXT_ESCAPE.sub(r"\\\g<0>", s)


def escape_role(s: str) -> str:
    return _ROLE_ESCAPE.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def _show(x) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _show(x).strip(),
    "upper": lambda x: _show(x).upper(),
    "lower": lambda x: _show(x).lower(),
    "length": lambda x: len(x),
    "string": _show,
    "escape_text": lambda x: escape_text(_show(x)),
    "escape_role": lambda x: escape_role(_show(x)),
}


class TemplateError(ValueError):
    pass


# ---- syntax tree -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    expr: object


@dataclass(frozen=True)
class Assign:
    name: str
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{([{%])(-?)(.*?)(-?)[}%]\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~+|.\[\]()=]))""")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, value: str) -> None:
        if not self.peek(value):
            raise TemplateError(f"{value!r} expected")
        self.at += 1

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1].startswith("_"):
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def choice(self):
        e = self.either()
        if self.peek("if"):
            self.at += 1
            test = self.either()
            self.take("else")
            return Op("choice", (test, e, self.choice()))
        return e

    def chain(self, ops: tuple, below: Callable):
        e = below()
        while self.peek(*ops):
            op = self.tokens[self.at][1]
            self.at += 1
            e = Op(op, (e, below()))
        return e

    def either(self):
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self):
        if self.peek("not"):
            self.at += 1
            return Op("not", (self.negated(),))
        return self.chain(("==", "!=", "in"), lambda: self.chain(("~",), lambda: self.chain(("+",), self.filtered)))

    def filtered(self):
        e = self.primary()
        while self.peek(".", "[", "|"):
            op = self.tokens[self.at][1]
            self.at += 1
            if op == ".":
                e = Item(e, Const(self.name()))
            elif op == "[":
                e = Item(e, self.choice())
                self.take("]")
            else:
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = Filter(name, e)
        return e

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return Const(int(value))
        if value == "(":
            self.at += 1
            e = self.choice()
            self.take(")")
            return e
        if value in ("true", "false", "none"):
            self.at += 1
            return Const({"true": True, "false": False, "none": None}[value])
        return Name(self.name())


def parse(template: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        parts.append(("text", (text.lstrip() if strip else text).rstrip() if m[2] else text.lstrip() if strip else text))
        parts.append(("{" + m[1], m[3].strip()))
        at, strip = m.end(), bool(m[4])
    parts.append(("text", template[at:].lstrip() if strip else template[at:]))
    i = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal i
        nodes = []
        while i < len(parts):
            kind, source = parts[i]
            i += 1
            if kind == "text":
                if source:
                    nodes.append(Text(source))
                continue
            if kind == "{{":
                nodes.append(Print(_Expression(source).whole()))
                continue
            word, _, rest = source.partition(" ")
            if word in ends:
                return tuple(nodes), source
            if word == "for":
                e = _Expression(rest)
                name = e.name()
                e.take("in")
                over = e.whole()
                nodes.append(For(name, over, body("endfor")[0]))
            elif word == "if":
                nodes.append(condition(rest))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.take("=")
                nodes.append(Assign(name, e.whole()))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def condition(rest: str) -> If:
        test = _Expression(rest).whole()
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(test, then, (condition(end.partition(" ")[2]),))
        return If(test, then, body("endif")[0] if end == "else" else ())

    return body()[0]


# ---- constant folding ------------------------------------------------------------------------------


def _apply(op: str, args: list):
    if op == "not":
        return not args[0]
    a, b = args
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b
    if op == "~":
        return _show(a) + _show(b)
    if type(a) is type(b) and type(a) in (int, str):
        return a + b
    raise TemplateError("+ takes two texts or two integers")


def fold(node):
    """The same tree with constant parts worked out, constant branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif y != Text(""):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op == "choice":
            return args[1 if args[0].value else 2] if isinstance(args[0], Const) else Op("choice", args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Print):
        e = fold(node.expr)
        return Text(_show(e.value)) if isinstance(e, Const) else Print(e)
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.expr))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    return node


# ---- closures --------------------------------------------------------------------------------------


@dataclass
class Sink:
    """The formatted text so far, and the (start, end) spans that generation markers cover."""

    parts: list = field(default_factory=list)
    at: int = 0
    spans: list = field(default_factory=list)

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.at += len(s)


def _item(of, key):
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, list) and type(key) is int:
        return of[key] if key < len(of) else None
    return None


def _expression(e) -> Callable:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):
        return lambda scope, n=e.name: scope.get(n)
    if isinstance(e, Item):
        of, key = _expression(e.of), _expression(e.key)
        return lambda scope: _item(of(scope), key(scope))
    if isinstance(e, Filter):
        f, of = FILTERS[e.name], _expression(e.of)
        return lambda scope: f(of(scope))
    args = [_expression(a) for a in e.args]
    if e.op == "choice":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    if e.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope, op=e.op: _apply(op, [a(scope) for a in args])


def _statements(nodes: tuple) -> Callable:
    steps = [_statement(n) for n in nodes]

    def run(scope: dict, sink: Sink) -> None:
        for s in steps:
            s(scope, sink)

    return run


def _statement(n) -> Callable:
    if isinstance(n, Text):
        return lambda scope, sink: sink.write(n.text)
    if isinstance(n, Print):
        value = _expression(n.expr)
        return lambda scope, sink: sink.write(_show(value(scope)))
    if isinstance(n, Assign):
        value = _expression(n.expr)
        return lambda scope, sink: scope.__setitem__(n.name, value(scope))
    if isinstance(n, If):
        test, then, other = _expression(n.test), _statements(n.then), _statements(n.other)
        return lambda scope, sink: then(scope, sink) if test(scope) else other(scope, sink)
    if isinstance(n, Generation):
        body = _statements(n.body)

        def generation(scope: dict, sink: Sink) -> None:
            start = sink.at
            body(scope, sink)
            sink.spans.append((start, sink.at))

        return generation
    over, body = _expression(n.over), _statements(n.body)

    def loop(scope: dict, sink: Sink) -> None:
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("for takes a list")
        for i, x in enumerate(items):
            body(scope | {n.name: x, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, sink)

    return loop


def compile_template(template: str) -> Callable[[list], tuple[str, list]]:
    """A function from a list of {role, content} to (text, generated spans)."""
    run = _statements(fold(parse(template)))

    def render(messages: list) -> tuple[str, list]:
        sink = Sink()
        run({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans

    return render


# ---- reading back ----------------------------------------------------------------------------------

#: Stretches between escapes are taken whole and never given back, so a turn of any length costs its own size.
_TURN = re.compile(re.escape(TURN_OPEN) + r"([^\\:]*+(?:\\.[^\\:]*+)*+)" + re.escape(ROLE_END) + r"([^\\<]*+(?:\\.[^\\<]*+)*+)" + re.escape(TURN_CLOSE), re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE made."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


# ---- operators -------------------------------------------------------------------------------------


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted string, loss_spans array<struct<start,end>>): one row per conversation.

    Rows are dealt by conv_id and sorted in their partition, and a worker holds one conversation at a time: the table is
    never grouped into one task by anything but a conversation, whose formatted text is one value anyway.
    """
    render_of = template
    compile_template(template)  # a faulty template fails here, not on the executors
    spark = conversations.sparkSession
    small_batches(spark)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(span))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, wrap = compile_template(render_of), batches(schema)
        missing = object()
        now, messages, out = missing, [], ([], [], [])

        def close() -> None:
            text, spans = render(messages)
            for column, value in zip(out, (now, text, [{"start": a, "end": b} for a, b in spans])):
                column.append(value)

        for b in parts:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if now is missing or conv != now:
                    if now is not missing:
                        close()
                    now, messages = conv, []
                messages.append({"role": role or "", "content": text or ""})
            if len(out[0]) >= 200:
                yield wrap(list(out))
                out = ([], [], [])
        if now is not missing:
            close()
        yield wrap(list(out))

    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Reads the formatted texts back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            out: list[list] = [[] for _ in schema]
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                all_turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_turns(text):
                    all_turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                for column, value in zip(out, (conv, n, all_turns.hexdigest(), chars, loss.hexdigest(), len(text))):
                    column.append(value)
            yield wrap(out)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
