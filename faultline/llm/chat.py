"""Chat formatting: a small template language, compiled to Python closures that render conversations and loss masks.

Language: text; ``{{ expression }}``; ``{% for x in messages %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``,
``{% set x = expression %}``, ``{% generation %}`` (what it renders is under the loss mask), each closed by ``{% end... %}``.
Expressions: strings, integers, ``true`` / ``false`` / ``none``, names, fields (``m.role`` or ``m['role']``), ``not and or``,
comparisons, ``in``, ``+`` and ``-`` of numbers, ``~`` (joined as text), brackets and filters ``| lower | upper | trim | length | escape``. In
loops ``loop.index``, ``loop.index0``, ``loop.first`` and ``loop.previous`` (the turn before, or none) are known. ``-`` beside a marker strips
white space on that side.

A template is parsed into a syntax tree of tuples, constant parts of which are evaluated once; then each node becomes a
closure. The sandbox: closures know the given variables, plain fields of turns and the filters above; there are no calls,
no attributes of Python objects, no unbounded loops.

Texts are made safe by ``escape``: a backslash is doubled and one is put behind the first character of every control
string, so none is left; ``unescape`` takes both back. A template's control strings must not overlap (checked), so that the
first one found behind a text is the template's own.

Rendering is lazy, turn by turn, in the order of the rows: conversations are dealt by id, sorted within their task and
written in parts of about ``PART`` characters, so neither the longest conversation nor its output has to fit into memory. SHA-256 of
a whole conversation is sequential, so one task reads one conversation.

Defined results: null texts and roles are empty; equal turns go by role, then text; repeated rows are turns; rows with a
null conv_id are one conversation, null turns come first; turns of unknown roles are framed with their role; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 20  # characters

#: Fixed values of the template: what must not stand in a text.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|says|>", "<|end|>"]

TEMPLATE = """
{%- for m in messages -%}
  {%- if loop.first -%} {{ '<s>' }} {%- endif -%}
  {%- if m.role == 'user' -%} {{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
  {%- elif m.role == 'system' -%} {{ '<<SYS>>' ~ (m.text | escape) ~ '<</SYS>>' }}
  {%- elif m.role == 'assistant' -%} {%- generation -%} {{ m.text | escape }} {%- endgeneration -%} {{ '</s>' }}
  {%- else -%} {{ '<|turn|>' ~ (m.role | escape) ~ '<|says|>' ~ (m.text | escape) ~ '<|end|>' }}
  {%- endif -%}
{%- endfor -%}
"""

#: How the turns of ``TEMPLATE`` are found again; a turn without an opening string is the assistant's.
TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|<\|turn\|>(?P<role>.*?)<\|says\|>(?P<other>.*?)<\|end\|>|(?P<assistant>.*?)</s>", re.DOTALL)


# ---- escaping ---------------------------------------------------------------------------


def overlapping(controls: list[str]) -> list[tuple[str, str]]:
    """Pairs of control strings of which the end of one begins the other."""
    return [(a, b) for a in controls for b in controls for n in range(1, min(len(a), len(b))) if a.endswith(b[:n])]


def escaper(controls: list[str]) -> Callable[[str], str]:
    """Doubles backslashes and breaks control strings behind their first character."""
    if overlapping(controls) or any("\\" in c or len(c) < 2 for c in controls):
        raise ValueError(f"control strings overlap, hold a backslash or are single characters: {overlapping(controls)}")
    found = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)]))
    return lambda text: found.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)|\\", r"\1", text)


# ---- template language ------------------------------------------------------------------

TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>()\[\]|~+.=-]))")
WORDS = {"true": True, "false": False, "none": None}
FILTERS = {"lower": lambda v: _text(v).lower(), "upper": lambda v: _text(v).upper(), "trim": lambda v: _text(v).strip(), "length": len}
COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
           "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b)}


class TemplateError(ValueError):
    """The template is not of the language."""


def _text(value) -> str:
    return "" if value is None else str(value)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Expression:
    """Recursive descent over the tokens of one expression, into tuples (kind, ...)."""

    def __init__(self, source: str) -> None:
        self.tokens = _tokens(source)
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while sign := self.take(*COMPARE):
            node = ("op", sign, node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while sign := self.take(*ARITHMETIC):
            node = ("op", sign, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.field()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def field(self) -> tuple:
        node = self.value()
        while sign := self.take(".", "["):
            node = ("field", node, ("const", self.name())) if sign == "." else ("field", node, self.either())
            if sign == "[":
                self.need("]")
        return node

    def name(self) -> str:
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name":
            raise TemplateError(f"name expected, not {word!r}")
        self.at += 1
        return word

    def value(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("string", "number"):
            kind, word = self.tokens[self.at]
            self.at += 1
            return ("const", int(word) if kind == "number" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        word = self.name()
        return ("const", WORDS[word]) if word in WORDS else ("name", word)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = re.split(r"(\{[%{]-?.*?-?[%}]\})", source, flags=re.DOTALL)
    for i in range(1, len(pieces), 2):
        if pieces[i][2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    found = [("text", p) if i % 2 == 0 else ("print" if p[1] == "{" else "tag", p[2:-2].strip("-").strip()) for i, p in enumerate(pieces)]
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(found):
            kind, body = found[at]
            at += 1
            if kind == "text":
                out.append(("const", body))
            elif kind == "print":
                out.append(Expression(body).whole())
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("all", *out), body
                out.append(tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} expected")
        return ("all", *out), ""

    def tag(word: str, rest: str) -> tuple:
        if word == "if":
            test = Expression(rest).whole()
            then, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                return ("if", test, then, tag("if", end[4:].strip()))
            return ("if", test, then, block("endif")[0] if end == "else" else ("const", ""))
        if m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL) if word == "for" else None:
            return ("for", m[1], Expression(m[2]).whole(), block("endfor")[0])
        if m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.DOTALL) if word == "set" else None:
            return ("set", m[1], Expression(m[2]).whole())
        if word == "generation" and not rest:
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


def folded(node: tuple, filters: dict) -> tuple:
    """The same tree with constant parts evaluated and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    parts = tuple(folded(x, filters) if isinstance(x, tuple) else x for x in node[1:])
    fixed = all(x[0] == "const" for x in parts if isinstance(x, tuple))
    if kind == "if" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "all":
        out: list[tuple] = []
        for x in (y for p in parts for y in (p[1:] if p[0] == "all" else (p,))):
            if x[0] == "const" and out and out[-1][0] == "const":
                out[-1] = ("const", _text(out[-1][1]) + _text(x[1]))
            elif x != ("const", ""):
                out.append(x)
        return out[0] if len(out) == 1 else ("all", *out) if out else ("const", "")
    if fixed and kind in ("op", "not", "and", "or", "filter", "field"):
        return ("const", evaluator((kind, *parts), filters)({}))
    return (kind, *parts)


def evaluator(node: tuple, filters: dict) -> Callable[[dict], object]:
    """A closure from variables to the value of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "not":
        inner = evaluator(node[1], filters)
        return lambda names: not inner(names)
    if kind in ("and", "or"):
        a, b = (evaluator(x, filters) for x in node[1:])
        return (lambda names: a(names) and b(names)) if kind == "and" else (lambda names: a(names) or b(names))
    if kind == "op":
        apply = {**COMPARE, **ARITHMETIC}[node[1]]
        a, b = (evaluator(x, filters) for x in node[2:])
        return lambda names: apply(a(names), b(names))
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        apply, inner = filters[node[1]], evaluator(node[2], filters)
        return lambda names: apply(inner(names))
    if kind == "field":
        inner, key = (evaluator(x, filters) for x in node[1:])

        def field(names):
            held = inner(names)
            return held.get(key(names)) if isinstance(held, dict) else None

        return field
    raise TemplateError(f"{kind!r} is no expression")


Piece = tuple[str, bool]


def renderer(node: tuple, filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    """A closure from variables to pieces of text, each with whether it is under the loss mask."""
    kind = node[0]
    if kind == "all":
        inner = [renderer(x, filters) for x in node[1:]]
        return lambda names, loss: (p for r in inner for p in r(names, loss))
    if kind == "if":
        test, (then, other) = evaluator(node[1], filters), (renderer(x, filters) for x in node[2:])
        return lambda names, loss: then(names, loss) if test(names) else other(names, loss)
    if kind == "generation":
        body = renderer(node[1], filters)
        return lambda names, loss: body(names, True)
    if kind == "set":
        name, value = node[1], evaluator(node[2], filters)

        def put(names, loss):
            names[name] = value(names)
            yield from ()

        return put
    if kind == "for":
        name, rows, body = node[1], evaluator(node[2], filters), renderer(node[3], filters)

        def loop(names, loss):
            before, outer = None, (names.get(name), names.get("loop"))
            for i, row in enumerate(rows(names) or ()):
                names[name], names["loop"] = row, {"index0": i, "index": i + 1, "first": i == 0, "previous": before}
                yield from body(names, loss)
                before = row
            names[name], names["loop"] = outer

        return loop
    value = evaluator(node, filters)

    def show(names, loss):
        yield _text(value(names)), loss

    return show


class Template:
    """A compiled template; ``render`` yields (text, under the loss mask) as the turns come in."""

    def __init__(self, source: str = TEMPLATE, controls: list[str] = CONTROLS) -> None:
        escape = escaper(controls)
        filters = {**FILTERS, "escape": lambda v: escape(_text(v))}
        self.tree = folded(parse(source), filters)
        self._render = renderer(self.tree, filters)

    def render(self, messages, **names) -> Iterator[Piece]:
        return (p for p in self._render({**names, "messages": messages}, False) if p[0])


# ---- Spark ------------------------------------------------------------------------------


def _conversations(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    """(id, its turns) one after another from sorted rows; turns are read as they are asked for."""
    rows = (r for pdf in batches for r in zip(*(pdf[c].tolist() for c in ("conv_id", "role", "text")), strict=True))
    held = next(rows, None)
    while held is not None:
        now = held[0]

        def turns():
            nonlocal held
            while held is not None and held[0] == now:
                yield {"role": held[1], "text": held[2]}
                held = next(rows, None)

        mine = turns()
        yield now, mine
        for _ in mine:
            pass


def format_conversations(conversations: DataFrame, source: str = TEMPLATE, controls: list[str] = CONTROLS,
                         part_chars: int = PART) -> DataFrame:
    """conv_id (as text; null: null), part, formatted, loss: conversations in parts, and the [start, end) spans of each part
    under the loss mask. A part ends with a turn, unless the turn alone is longer than a part. Parts come in order."""
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        template = Template(source, controls)
        rows: list[tuple] = []
        waiting = 0

        def frame():
            nonlocal rows, waiting
            out = pd.DataFrame(rows, columns=["conv_id", "part", "formatted", "loss"])
            rows, waiting = [], 0
            return out

        for conv, turns in _conversations(batches):
            part, pieces, spans, size, done = 0, [], [], 0, 0
            name = conv[1:] if conv else None

            def counted(turns=turns):
                nonlocal done
                for turn in turns:
                    yield turn
                    done = 1  # what was asked for next comes after a whole turn

            for text, loss in template.render(counted()):
                if done and size >= part_chars:
                    rows.append((name, part, "".join(pieces), spans))
                    waiting += size
                    part, pieces, spans, size = part + 1, [], [], 0
                    yield frame()
                done = 0
                if loss:
                    spans.append([size, size + len(text)])
                pieces.append(text)
                size += len(text)
            rows.append((name, part, "".join(pieces), spans))
            waiting += size
            if waiting >= part_chars or len(rows) >= 4096:
                yield frame()
        yield frame()

    return sorted_.select("conv_id", "role", "text").mapInPandas(run, "conv_id string, part int, formatted string, loss array<array<int>>")


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a text made with ``TEMPLATE``."""
    at = 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        at = m.end()
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["other"])
        else:
            role = m.lastgroup
            yield role, unescape(m[role])


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from its formatted parts in order (as ``format_conversations`` gives them): number and digest of its turns,
    length and digest of what is under the loss mask, length of the whole."""
    def run(batches):
        now, state, out = None, None, []

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def frame(rows):
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for pdf in batches:
            for conv, part, formatted, loss in pdf[["conv_id", "part", "formatted", "loss"]].itertuples(index=False):
                if part == 0:
                    if state:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for start, end in loss:
                    text = unescape(formatted[start:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(out) >= 4096:
                yield frame(out)
                out = []
        yield frame([*out, *([row()] if state else [])])

    return parts.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
