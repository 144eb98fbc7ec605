"""A small template language for conversations: parsed to a syntax tree, constants folded, compiled to closures.

    {{ expression }}                       its text
    {% for name in expression %} ... {% endfor %}   with loop.index0, loop.index, loop.first, loop.last
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}        text that the loss counts

Expressions: strings, integers, true, false, none, names, a.b and a["b"] (keys of mappings only), + == != < > <= >=, in, not,
and, or, parentheses, and filters after a bar. There are no calls and no Python attributes, so a template reaches nothing
but the values and filters that it is given. A loop takes its sequence item by item with one item of
lookahead, so that a template renders conversations of any length in constant memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed, or that asks for what isn't there."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter, by name, on its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else show(a) + show(b),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "in": lambda a, b: a in b,
    "not": operator.not_,
}

FILTERS: dict[str, Callable] = {"upper": lambda s: show(s).upper(), "lower": lambda s: show(s).lower(), "trim": lambda s: show(s).strip(), "length": len}

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>()|.\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}
#: Operators by how tightly they bind, loosest first.
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+",))


def show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        end = 0
        while source[end:].strip():
            if not (m := _TOKEN.match(source, end)):
                raise TemplateError(f"unexpected text in a tag: {source[end:].strip()[:40]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            end = m.end()

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, None)
        return None if kind in (1, 2) else text

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if got is None or wanted and got not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted) or 'a name'} in a tag")
        self.at += 1
        return got

    def name(self) -> str:
        got = self.take()
        if not got.isidentifier():
            raise TemplateError(f"{got!r} is no name")
        return got

    def level(self, n: int = 0) -> Any:
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in _LEVELS[n]:
            left = Apply(self.take(), (left, self.level(n + 1)))
        return left

    def unary(self) -> Any:
        if self.peek() == "not":
            self.take()
            return Apply("not", (self.unary(),))
        value = self.primary()
        while (sign := self.peek()) in (".", "[", "|"):
            self.take()
            if sign == ".":
                value = Item(value, Const(self.name()))
            elif sign == "[":
                value = Item(value, self.level())
                self.take("]")
            else:
                f = self.name()
                if f not in self.filters:
                    raise TemplateError(f"no filter {f!r}")
                value = Apply("|" + f, (value,))
        return value

    def primary(self) -> Any:
        if self.at == len(self.tokens):
            raise TemplateError("a tag ends too early")
        kind, text = self.tokens[self.at]
        if kind == 1:
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == 2:
            self.at += 1
            return Const(int(text))
        if text == "(":
            self.take()
            value = self.level()
            self.take(")")
            return value
        name = self.name()
        return Const(_WORDS[name]) if name in _WORDS else Name(name)

    def whole(self) -> Any:
        value = self.level()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in a tag")
        return value


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    end = 0
    for m in _TAGS.finditer(source):
        pieces.append(("text", source[end : m.start()]))
        pieces.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        end = m.end()
    pieces.append(("text", source[end:]))
    at = 0

    def block(*until: str) -> tuple[tuple, str, _Expression | None]:
        """Nodes up to a tag of one of these names; that name, and the rest of the tag."""
        nonlocal at
        nodes: list = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                nodes += [Text(text)] if text else []
                continue
            e = _Expression(text, filters)
            if kind == "print":
                nodes.append(Print(e.whole()))
                continue
            word = e.take()
            if word in until:
                return tuple(nodes), word, e
            if word == "set":
                name = e.name()
                e.take("=")
                nodes.append(Set(name, e.whole()))
            elif word == "for":
                name = e.name()
                e.take("in")
                over = e.whole()
                nodes.append(For(name, over, block("endfor")[0]))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            elif word == "if":
                nodes.append(branch(e))
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return tuple(nodes), "", None

    def branch(e: _Expression) -> If:
        test = e.whole()
        yes, word, more = block("elif", "else", "endif")
        if word == "elif":
            return If(test, yes, (branch(more),))
        return If(test, yes, block("endif")[0] if word == "else" else ())

    return block()[0]


def fold(node: Any, filters: Mapping[str, Callable] = FILTERS) -> Any:
    """The tree with constant expressions computed, dead branches cut and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for n in node:
            n = fold(n, filters)
            if isinstance(n, Print) and isinstance(n.value, Const):
                n = Text(show(n.value.value))
            if isinstance(n, If) and isinstance(n.test, Const):
                more = n.yes if n.test.value else n.no
            else:
                more = (n,)
            for x in more:
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif not (isinstance(x, Text) and not x.text):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name not in ("and", "or") and all(isinstance(a, Const) for a in args):
            f = filters[node.name[1:]] if node.name[0] == "|" else OPERATORS[node.name]
            try:
                return Const(f(*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(f"{node.name} can't take these values: {e}") from e
        return Apply(node.name, args)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Print):
        return Print(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, If):
        return If(fold(node.test, filters), fold(node.yes, filters), fold(node.no, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


#: Pieces of rendered text, each with whether the loss counts it.
Pieces = Iterator[tuple[str, bool]]


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env: dict, n: str = node.name) -> Any:
            if n not in env:
                raise TemplateError(f"no value {n!r}")
            return env[n]

        return name
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env: dict) -> Any:
            holder, k = of(env), key(env)
            if not isinstance(holder, Mapping):
                raise TemplateError(f"{k!r} is asked of what has no keys")
            return holder.get(k)

        return item
    args = [_value(a, filters) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    f = filters[node.name[1:]] if node.name[0] == "|" else OPERATORS[node.name]
    return (lambda env, a=args[0]: f(a(env))) if len(args) == 1 else (lambda env, a=args[0], b=args[1]: f(a(env), b(env)))


def _looped(items: Iterable) -> Iterator[tuple[Any, dict]]:
    it = iter(items)
    index, end = 0, object()
    now = next(it, end)
    while now is not end:
        after = next(it, end)
        yield now, {"index0": index, "index": index + 1, "first": index == 0, "last": after is end}
        now, index = after, index + 1


def _body(nodes: tuple, filters: Mapping[str, Callable], counted: bool) -> Callable[[dict], Pieces]:
    steps = [_step(n, filters, counted) for n in nodes]

    def run(env: dict) -> Pieces:
        for s in steps:
            yield from s(env)

    return run


def _step(node: Any, filters: Mapping[str, Callable], counted: bool) -> Callable[[dict], Iterable[tuple[str, bool]]]:
    if isinstance(node, Text):
        return lambda env, out=((node.text, counted),): out
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda env: ((show(value(env)), counted),)
    if isinstance(node, Set):
        value = _value(node.value, filters)
        return lambda env: env.__setitem__(node.name, value(env)) or ()
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, If):
        test, yes, no = _value(node.test, filters), _body(node.yes, filters, counted), _body(node.no, filters, counted)
        return lambda env: (yes if test(env) else no)(env)
    over, body = _value(node.over, filters), _body(node.body, filters, counted)

    def loop(env: dict) -> Pieces:
        inner = dict(env)
        for inner[node.name], inner["loop"] in _looped(over(env)):
            yield from body(inner)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] = FILTERS) -> Callable[[dict], Pieces]:
    """A function from values to pieces of text, in order."""
    return _body(fold(parse(source, filters), filters), filters, False)
