"""Chat formatting: a small sandboxed template language, compiled to closures.

``compile_template`` parses a template into a syntax tree, folds what is constant and builds
one Python generator per node. A rendering is a stream of ``(piece, marked)``; pieces inside
``{% generation %}`` are marked, which is the loss mask. Loops pull their items one at a time,
so a conversation of any length is rendered in the memory of one turn.

Language: ``{{ expression }}``, ``{% for name in expression %}``, ``{% if %}``, ``{% elif %}``,
``{% else %}``, ``{% set name = expression %}``, ``{% generation %}``, each closed by ``{% end...
%}``, comments ``{# #}`` and ``-`` to trim white space. Expressions: strings, integers, ``true``,
``false``, ``none``, names, ``a.b`` and ``a['b']`` on mappings, ``==``, ``!=``, ``in``, ``and``,
``or``, ``not``, ``+``, parentheses and the filters in ``FILTERS``. Nothing else exists: no
calls, no attributes of Python objects, no imports.

``control`` escapes control strings reversibly (``plain`` undoes it), so that no text can end a
turn or begin one.

Defined results: null texts and roles are empty; turns of a conversation go by turn, then role
and text, null turns first; rows with the same turn are both kept; conversations without an id
are one conversation. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sharewise.llm.text import decoded, raw

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = """
{%- for message in messages -%}
{{ '<|im_start|>' + message.role | control_line + '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | control }}{% endgeneration %}
{%- else -%}
{{ message.text | control }}
{%- endif -%}
{{ '<|im_end|>' + '\\n' }}
{%- endfor -%}
"""


class TemplateError(ValueError):
    """The template is not a sentence of the language, or asks for what it does not have."""


def control(text: str) -> str:
    """Escape so that ``<|`` never occurs; backslashes are doubled."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def control_line(text: str) -> str:
    """``control`` for what must stay on one line."""
    return control(text).replace("\n", "\\n")


def plain(text: str) -> str:
    """Undo ``control`` or ``control_line``."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {
    "control": control,
    "control_line": control_line,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}

# --- parsing -------------------------------------------------------------------------------

_TAGS = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.DOTALL)
_TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[()\[\]|.+]))"
)
_NAMED = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", *_NAMED}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"not understood: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens; trees are tuples ``(kind, ...)``."""

    def __init__(self, source: str):
        self.tokens, self.at, self.source = _tokens(source), 0, source

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"too much in {self.source!r}")
        return tree

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.added()
        while sign := self.take("==", "!=", "in"):
            left = (sign, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def value(self) -> tuple:
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "text":
            body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1])
            tree: tuple = ("constant", body)
        elif kind == "number":
            tree = ("constant", int(token))
        elif kind == "name" and token in _NAMED:
            tree = ("constant", _NAMED[token])
        elif kind == "name" and token not in _WORDS:
            tree = ("name", token)
        elif (kind, token) == ("sign", "("):
            tree = self.either()
            self.need(")")
        else:
            raise TemplateError(f"a value is missing in {self.source!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, token = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
                if kind != "name":
                    raise TemplateError(f"a name is missing in {self.source!r}")
                self.at += 1
                tree = ("item", tree, ("constant", token))
            else:
                tree = ("item", tree, self.either())
                self.need("]")
        return tree


def parse(template: str) -> list[tuple]:
    """The template's syntax tree: a list of nodes."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAGS.finditer(template):
        before = template[at : m.start()]
        before = before.lstrip() if trim else before
        parts.append(("text", before.rstrip() if m[0][2] == "-" else before))
        if m[1] is not None:
            parts.append(("show", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at, trim = m.end(), m[0][-3] == "-"
    parts.append(("text", template[at:].lstrip() if trim else template[at:]))
    nodes, ended = _block(iter(parts), ())
    return nodes


def _block(parts: Iterator[tuple[str, str]], ends: tuple[str, ...]) -> tuple[list[tuple], str]:
    nodes: list[tuple] = []
    for kind, body in parts:
        if kind == "text":
            nodes.append(("text", body))
            continue
        if kind == "show":
            nodes.append(("show", _Expression(body).whole()))
            continue
        word = body.split(None, 1)[0] if body else ""
        rest = body[len(word) :].strip()
        if word in ends:
            return nodes, body
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
            inner, _ = _block(parts, ("endfor",))
            nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "if":
            nodes.append(_branches(parts, rest))
        elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)):
            nodes.append(("set", m[1], _Expression(m[2]).whole()))
        elif body == "generation":
            inner, _ = _block(parts, ("endgeneration",))
            nodes.append(("generation", inner))
        else:
            raise TemplateError(f"there is no tag {body!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return nodes, ""


def _branches(parts: Iterator[tuple[str, str]], condition: str) -> tuple:
    cases, test = [], _Expression(condition).whole()
    while True:
        inner, ended = _block(parts, ("elif", "else", "endif"))
        cases.append((test, inner))
        if ended == "else":
            inner, _ = _block(parts, ("endif",))
            return ("if", cases, inner)
        if ended == "endif":
            return ("if", cases, [])
        test = _Expression(ended[4:]).whole()


# --- folding -------------------------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _combine(kind: str, left: Any, right: Any) -> Any:
    if kind == "+":
        both = isinstance(left, int) and isinstance(right, int)
        return left + right if both else _text(left) + _text(right)
    if kind == "==":
        return left == right
    if kind == "!=":
        return left != right
    return _text(left) in right if isinstance(right, (str, dict)) else False


def fold_expression(tree: tuple) -> tuple:
    """The expression with every constant part worked out."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    if kind == "filter":
        inner = fold_expression(tree[2])
        done = inner[0] == "constant"
        return ("constant", FILTERS[tree[1]](_text(inner[1]))) if done else (kind, tree[1], inner)
    inner = [fold_expression(x) for x in tree[1:]]
    if kind == "not":
        return ("constant", not inner[0][1]) if inner[0][0] == "constant" else (kind, *inner)
    left, right = inner
    if kind in ("and", "or") and left[0] == "constant":
        return right if bool(left[1]) == (kind == "and") else left
    if left[0] == right[0] == "constant" and kind not in ("and", "or", "item"):
        return ("constant", _combine(kind, left[1], right[1]))
    if kind == "+" and left[0] == "+" and left[2][0] == right[0] == "constant":
        if isinstance(left[2][1], str):  # (x + 'a') + 'b'
            return ("+", left[1], ("constant", left[2][1] + _text(right[1])))
    return (kind, left, right)


def fold(nodes: list[tuple]) -> list[tuple]:
    """Nodes with constants shown as text, dead branches gone and neighbouring texts joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "show":
            tree = fold_expression(node[1])
            add(("text", _text(tree[1])) if tree[0] == "constant" else ("show", tree))
        elif node[0] == "for":
            add(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            cases, other = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] != "constant":
                    cases.append((test, fold(inner)))
                elif test[1]:
                    other = fold(inner)
                    break
            if cases:
                add(("if", cases, other))
            else:
                for inner_node in other:
                    add(inner_node)
        else:
            add(node)
    return out


# --- closures ------------------------------------------------------------------------------

Scope = dict[str, Any]


def _value(tree: tuple) -> Callable[[Scope], Any]:
    kind = tree[0]
    if kind == "constant":
        return lambda scope, x=tree[1]: x
    if kind == "name":

        def named(scope: Scope, name: str = tree[1]) -> Any:
            if name not in scope:
                raise TemplateError(f"there is no {name!r}")
            return scope[name]

        return named
    if kind == "filter":
        return lambda scope, f=FILTERS[tree[1]], x=_value(tree[2]): f(_text(x(scope)))
    if kind == "not":
        return lambda scope, x=_value(tree[1]): not x(scope)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "item":

        def item(scope: Scope) -> Any:
            holder = left(scope)
            if not isinstance(holder, dict):
                raise TemplateError("only mappings have items")
            return holder.get(right(scope))

        return item
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope: _combine(kind, left(scope), right(scope))


Piece = tuple[str, bool]
Closure = Callable[[Scope, bool], Iterator[Piece]]


def _closure(nodes: list[tuple]) -> Closure:
    steps = [_step(node) for node in nodes]

    def run(scope: Scope, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(node: tuple) -> Closure:
    kind = node[0]
    if kind == "text":

        def text(scope: Scope, marked: bool) -> Iterator[Piece]:
            yield node[1], marked

        return text
    if kind == "show":
        value = _value(node[1])

        def show(scope: Scope, marked: bool) -> Iterator[Piece]:
            yield _text(value(scope)), marked

        return show
    if kind == "set":
        value = _value(node[2])

        def assign(scope: Scope, marked: bool) -> Iterator[Piece]:
            scope[node[1]] = value(scope)
            yield from ()

        return assign
    if kind == "generation":
        inner = _closure(node[1])
        return lambda scope, marked: inner(scope, True)
    if kind == "for":
        items, inner = _value(node[2]), _closure(node[3])

        def loop(scope: Scope, marked: bool) -> Iterator[Piece]:
            for x in items(scope) or ():
                yield from inner(scope | {node[1]: x}, marked)

        return loop
    cases = [(_value(test), _closure(inner)) for test, inner in node[1]]
    other = _closure(node[2])

    def choose(scope: Scope, marked: bool) -> Iterator[Piece]:
        for test, inner in cases:
            if test(scope):
                return inner(scope, marked)
        return other(scope, marked)

    return choose


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (mappings with ``role`` and ``text``) to marked pieces."""
    run = _closure(fold(parse(template)))
    return lambda messages: run({"messages": messages}, False)


# --- whole tables --------------------------------------------------------------------------


def ordered(conversations: DataFrame, key="conv_id", turn="turn", role="role", text="text"):
    """All rows of a conversation in one task, by turn; nothing is collected."""
    rows = conversations.select(
        F.col(key).alias("conv_id"),
        F.col(turn).alias("turn"),
        raw(role).alias("role"),
        raw(text).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Each conversation's id and its messages, one at a time; each must be read to its end."""

    def rows() -> Iterator[tuple[Any, dict]]:
        for batch in batches:
            for key, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                yield key.as_py(), {"role": decoded(role.as_py()), "text": decoded(text.as_py())}

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def messages() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                message = ahead[1]
                ahead = next(stream, None)
                yield message

        yield key, messages()


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """``(role, text, marked text)`` of each turn, from the rendering alone."""
    shown, marked = [], []
    for piece, is_marked in pieces:
        shown.append(piece)
        if is_marked:
            marked.append(piece)
        if piece.endswith(f"{END}\n"):
            turn = "".join(shown)
            if not turn.startswith(START):
                raise ValueError("a turn does not begin with its marker")
            role, _, text = turn[len(START) : -len(END) - 1].partition("\n")
            yield plain(role), plain(text), plain("".join(marked))
            shown, marked = [], []
    if "".join(shown):
        raise ValueError("a turn has no end")


def formatted(conversations: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """``conv_id``, the pieces' number and each piece with its mark, in order: the training text
    of a conversation is its pieces joined."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for name, messages in _conversations(batches):
            rows: list[tuple] = []
            for at, (piece, marked) in enumerate(run(messages)):
                rows.append((name, at, piece, marked))
                if len(rows) == 1000:
                    yield _rows(rows, kinds)
                    rows = []
            if rows:
                yield _rows(rows, kinds)

    rows_of, key = ordered(conversations, **columns), _key_field(conversations, **columns)
    schema = f"conv_id {key[0]}, position bigint, piece string, marked boolean"
    kinds = {
        "conv_id": key[1], "position": pa.int64(), "piece": pa.string(), "marked": pa.bool_()
    }
    return rows_of.mapInArrow(render, schema)


def _key_field(conversations: DataFrame, **columns: str) -> tuple[str, pa.DataType]:
    kind = conversations.schema[columns.get("key", "conv_id")].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), kinds.values(), strict=True)
    arrays = [pa.array(list(column), kind) for column, kind in columns]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


DIGEST = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def digests(conversations: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """What each conversation's rendering says when it is read back, as digests.

    The rendering streams through the reader, so a conversation of any length takes the memory
    of one turn. A digest runs over a conversation from end to end: one task per conversation.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rows = compile_template(template), []
        for name, messages in _conversations(batches):
            turns, loss, n, n_loss, n_shown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def counted(pieces: Iterator[Piece]) -> Iterator[Piece]:
                nonlocal n_shown
                for piece in pieces:
                    n_shown += len(piece[0])
                    yield piece

            for role, text, marked in read_back(counted(run(messages))):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(marked.encode())
                n, n_loss = n + 1, n_loss + len(marked)
            rows.append((name, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_shown))
            if len(rows) == 1000:
                yield _rows(rows, kinds)
                rows = []
        if rows:
            yield _rows(rows, kinds)

    key = _key_field(conversations, **columns)
    kinds = {"conv_id": key[1]}
    for name, kind in (part.split(" ") for part in DIGEST.split(", ")):
        kinds[name] = pa.int64() if kind == "bigint" else pa.string()
    return ordered(conversations, **columns).mapInArrow(read, f"conv_id {key[0]}, {DIGEST}")
