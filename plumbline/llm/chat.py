"""Chat formatting with a compiled template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures that write a conversation piece by piece and note which pieces are to be learnt.

The language: text, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expression %}``, ``{% generation %} ... {% endgeneration %}`` around what a model
should learn. Expressions have names, string, integer and boolean literals, ``none``, ``x.key``,
``x[key]``, ``==``, ``!=``, ``in``, ``and``, ``or``, ``not``, ``+``, ``~`` and filters after ``|``.

It is a sandbox: a name is one of the given variables, a key is looked up in dictionaries and
lists only, there are no calls, and only the filters below exist. Nothing reaches Python's
attributes. A loop may run over a stream, so a conversation of any length is written with one
message in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed strings that separate turns.
START, END = "<|im_start|>", "<|im_end|>"
#: The default template: each turn between control strings; what assistants say is to be learnt.
CHATML = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    """A template that can't be compiled, or an expression that can't be evaluated."""


def escape(text: str) -> str:
    """A text in which no control string begins; ``unescape`` gives it back."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return text.replace("<|", "<\\|") if "<|" in text else text


def escape_line(text: str) -> str:
    """The same for a text that must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)), "escape_line": lambda x: escape_line(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(), "length": lambda x: _length(x), "string": lambda x: _text(x),
}
#: Parentheses, operators and blocks that may be nested in a template.
DEEPEST = 32


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x) if isinstance(x, (int, bool)) else _fail(f"no text: {type(x).__name__}")


def _fail(what: str) -> Any:
    raise TemplateError(what)


def _length(x: Any) -> int:
    return len(x) if isinstance(x, (str, list, dict)) else _fail(f"no length: {type(x).__name__}")


def _key(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


# Syntax tree: ("const", v), ("name", n), ("key", of, key), ("not", x), ("op", name, a, b), ("filter", name, x);
# statements: ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)...], body), ("set", name, e), ("generation", body).

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[|.~+()\[\]]))")
_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "in": lambda a, b: a in b if isinstance(b, list) or isinstance(b, (dict, str)) and isinstance(a, str) else False,
}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at) or _fail(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.i = self.depth = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        if self.peek()[1] in values and self.peek()[0] != "str":
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        return tree if self.peek()[0] == "end" else _fail(f"unexpected {self.peek()[1]!r}")

    def deeper(self, parse: Callable[[], tuple]) -> tuple:
        """What lies one level further in; a tree is walked by recursion, so it may not be too deep."""
        self.depth += 1
        tree = parse() if self.depth <= DEEPEST else _fail("nested too deeply")
        self.depth -= 1
        return tree

    def chain(self, part: Callable[[], tuple], *operators: str) -> tuple:
        """Parts between operators, from left to right; each operator makes the tree a level deeper."""
        left, n = part(), 0
        while op := self.take(*operators):
            n += 1
            left = ("op", op, left, part()) if n <= DEEPEST else _fail("too many operators")
        return left

    def either(self) -> tuple:
        return self.chain(self.both, "or")

    def both(self) -> tuple:
        return self.chain(self.negated, "and")

    def negated(self) -> tuple:
        return ("not", self.deeper(self.negated)) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        return self.chain(self.added, "==", "!=", "in")

    def added(self) -> tuple:
        return self.chain(self.filtered, "+", "~")

    def filtered(self) -> tuple:
        left, n = self.keyed(), 0
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                _fail(f"no filter {name!r}")
            self.i, n = self.i + 1, n + 1
            if n > DEEPEST:
                _fail("too many filters")
            left = ("filter", name, left)
        return left

    def keyed(self) -> tuple:
        left = self.single()
        for _ in range(DEEPEST):
            if self.take("."):
                kind, name = self.peek()
                self.i += 1
                left = ("key", left, ("const", name)) if kind == "name" else _fail("a name must follow a dot")
            elif self.take("["):
                left = ("key", left, self.deeper(self.either))
                self.take("]") or _fail("no ]")
            else:
                return left
        return _fail("too many keys")

    def single(self) -> tuple:
        kind, value = self.peek()
        self.i += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", known[value]) if value in known else ("name", value)
        if value == "(":
            tree = self.deeper(self.either)
            self.take(")") or _fail("no )")
            return tree
        return _fail(f"unexpected {value or 'end'!r}")


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False

    def text(s: str, strip_right: bool) -> None:
        s = s.lstrip() if trim else s
        s = s.rstrip() if strip_right else s
        if s:
            parts.append(("text", s))

    for m in _PART.finditer(template):
        text(template[at : m.start()], bool(m[1] or m[4]))
        trim, at = bool(m[3] or m[6]), m.end()
        if m[2] is not None:
            parts.append(("out", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
    text(template[at:], False)

    i = depth = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal depth
        depth += 1
        inner = within(*ends) if depth <= DEEPEST else _fail("nested too deeply")
        depth -= 1
        return inner

    def within(*ends: str) -> tuple[list[tuple], str]:
        nonlocal i
        out: list[tuple] = []
        while i < len(parts):
            kind, s = parts[i]
            i += 1
            word = s.split(None, 1)[0] if s.split() else ""
            if kind == "text":
                out.append(("text", s))
            elif kind == "out":
                out.append(("out", _Expression(s).whole()))
            elif word in ends:
                return out, s
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", s, re.S) or _fail(f"bad loop: {s}")
                out.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(?!=)(.+)", s, re.S) or _fail(f"bad set: {s}")
                out.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                out.append(("generation", body("endgeneration")[0]))
            elif word == "if":
                branches, last, condition = [], [], _Expression(s[2:]).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((condition, inner))
                    if end.startswith("elif"):
                        condition = _Expression(end[4:]).whole()
                        continue
                    if end.startswith("else"):
                        last = body("endif")[0]
                    break
                out.append(("if", branches, last))
            else:
                _fail(f"unexpected tag {s!r}")
        return (out, "") if not ends else _fail(f"no {ends[-1]}")

    return body()[0]


def fold(tree: tuple) -> tuple:
    """An expression with its constant parts worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    parts = [fold(x) if isinstance(x, tuple) else x for x in tree[1:]]
    if kind == "op" and parts[0] in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (parts[0] == "and") else parts[1]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", evaluator((kind, *parts))({}))
    return (kind, *parts)


def folded(body: list[tuple]) -> list[tuple]:
    """Statements with constants folded, settled branches taken and neighbouring text joined."""
    out: list[tuple] = []
    for s in body:
        if s[0] == "out":
            e = fold(s[1])
            s = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif s[0] == "set":
            s = ("set", s[1], fold(s[2]))
        elif s[0] == "for":
            s = ("for", s[1], fold(s[2]), folded(s[3]))
        elif s[0] == "generation":
            s = ("generation", folded(s[1]))
        elif s[0] == "if":
            branches, last = [], folded(s[2])
            for e, inner in ((fold(e), folded(inner)) for e, inner in s[1]):
                if e[0] == "const" and e[1]:
                    last = inner
                    break
                if e[0] != "const":
                    branches.append((e, inner))
            if not branches:
                out = _merged(out, last)
                continue
            s = ("if", branches, last)
        out = _merged(out, [s])
    return out


def _merged(out: list[tuple], more: list[tuple]) -> list[tuple]:
    for s in more:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)
    return out


def evaluator(tree: tuple) -> Callable[[dict], Any]:
    """A closure that evaluates an expression."""
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "key":
        of, key = evaluator(tree[1]), evaluator(tree[2])
        return lambda env: _key(of(env), key(env))
    if kind == "not":
        x = evaluator(tree[1])
        return lambda env: not x(env)
    if kind == "filter":
        f, x = FILTERS[tree[1]], evaluator(tree[2])
        return lambda env: f(x(env))
    a, b = evaluator(tree[2]), evaluator(tree[3])
    if tree[1] == "and":
        return lambda env: a(env) and b(env)
    if tree[1] == "or":
        return lambda env: a(env) or b(env)
    op = _OPS[tree[1]]
    return lambda env: op(a(env), b(env))


#: What comes after the last item of a loop; items may be null.
_OVER = object()
Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def writer(body: list[tuple]) -> Writer:
    """A closure that writes statements as (text, whether it is to be learnt)."""
    steps = [_statement(s) for s in body]

    def write(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, learn)

    return steps[0] if len(steps) == 1 else write


def _statement(s: tuple) -> Writer:
    kind = s[0]
    if kind == "text":
        return lambda env, learn, t=s[1]: iter(((t, learn),))
    if kind == "out":
        value = evaluator(s[1])
        return lambda env, learn: iter(((_text(value(env)), learn),))
    if kind == "generation":
        inner = writer(s[1])
        return lambda env, learn: inner(env, True)
    if kind == "set":
        value = evaluator(s[2])

        def assign(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
            env[s[1]] = value(env)
            return iter(())

        return assign
    if kind == "if":
        branches, last = [(evaluator(e), writer(b)) for e, b in s[1]], writer(s[2])

        def choose(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
            return next((b for e, b in branches if e(env)), last)(env, learn)

        return choose
    over, inner = evaluator(s[2]), writer(s[3])

    def loop(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        items = over(env)
        if isinstance(items, (int, float)):
            _fail(f"nothing to go through: {type(items).__name__}")
        source, saved = iter(items or ()), (env.get(s[1]), env.get("loop"))
        now, index = next(source, _OVER), 0
        while now is not _OVER:
            following = next(source, _OVER)
            env[s[1]], env["loop"] = now, {"index": index + 1, "index0": index, "first": index == 0, "last": following is _OVER}
            yield from inner(env, learn)
            now, index = following, index + 1
        env[s[1]], env["loop"] = saved

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (a list or a stream) to (text, whether it is to be learnt) pieces."""
    try:
        write = writer(folded(parse(template)))
    except RecursionError:  # chains within chains
        raise TemplateError("nested too deeply") from None

    def run(messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        try:
            yield from write({"messages": messages}, False)
        except RecursionError:
            raise TemplateError("nested too deeply") from None

    return run


def render(template: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation's text, and the spans of it that are to be learnt, in code points. Null items of a loop are items; null values have no text."""
    out, spans, at = [], [], 0
    for text, learn in compile_template(template)(messages):
        if text:
            out.append(text)
            if learn:
                spans.append((at, at + len(text)))
            at += len(text)
    return "".join(out), spans


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True)


def _batched(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    for row in rows:
        out.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str))
        if size >= chars:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """``conv_id, seq, piece, learn``: each conversation's text, cut before each message is read.

    ``learn`` holds the spans of a piece that are to be learnt. The pieces of a conversation, by
    ``seq``, concatenate to its text; they lie together, in order. Turns are ordered by number,
    those without one last, ties by role and text. Null roles and texts are empty, rows without
    a conv_id are one conversation, repeated rows are turns like any other, further columns are
    ignored, and an empty table gives no rows.

    Messages stream through the template, so a conversation may hold any number of them; it is
    written by one task, since each message may depend on those before it.
    """
    compile_template(template)  # so that errors are found on the driver

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template)

        def pieces() -> Iterator[tuple]:
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                begun = 0

                def messages(group: Iterator[tuple] = group) -> Iterator[dict]:
                    nonlocal begun
                    for r in group:
                        yield {"role": r[2] or "", "text": r[3] or ""}
                        begun += 1

                out: list[str] = []
                spans: list[dict] = []
                at, seq, told = 0, 0, 0
                for text, learn in write(messages()):
                    # The loop reads one message ahead, so each step of the count ends a piece.
                    if begun != told and out:
                        yield conv_id, seq, "".join(out), spans
                        out, spans, at, seq = [], [], 0, seq + 1
                    told = begun
                    if text:
                        out.append(text)
                        if learn:
                            spans.append({"start": at, "end": at + len(text)})
                        at += len(text)
                if out:
                    yield conv_id, seq, "".join(out), spans

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield from _batched(pieces(), ["conv_id", "seq", "piece", "learn"], [pa.int64(), pa.int64(), pa.string(), span])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.mapInArrow(written, "conv_id long, seq long, piece string, learn array<struct<start:long,end:long>>")


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that the default template wrote."""
    out, at = [], 0
    while at < len(piece):
        m = _TURN.match(piece, at) or _fail(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What the pieces of the default template say when read back: one row per conversation.

    ``formatted`` is the frame that ``format_conversations`` gives; its order is relied on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                turns, losses = hashlib.sha256(), hashlib.sha256()
                n = chars = total = 0
                for _, _, piece, learn in group:
                    total += len(piece)
                    for role, text in read_back(piece):
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode())
                    for span in learn:
                        learnt = unescape(piece[span["start"] : span["end"]])
                        chars += len(learnt)
                        losses.update(learnt.encode())
                yield conv_id, n, turns.hexdigest(), chars, losses.hexdigest(), total

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield from _batched(conversations(), names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
