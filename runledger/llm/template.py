"""A small sandboxed template language, compiled to Python closures.

``Template(source)`` parses the source into a syntax tree, folds constant expressions and
branches, and builds one closure per node. Output comes as pieces with a generation flag, so a
conversation of any length is rendered turn by turn.

Language: ``{{ expr }}``, ``{% if/elif/else/endif %}``, ``{% for x in expr %}..{% endfor %}``
(``loop.index``, ``loop.index0``, ``loop.first``), ``{% set x = expr %}``,
``{% generation %}..{% endgeneration %}`` (marks what the model should produce),
``{# comment #}``, ``-`` beside a delimiter strips white space. Expressions: strings, numbers,
true/false/none, names, ``a.b`` and ``a[b]`` on mappings and sequences, ``+ - * % ~``,
comparisons, ``in``, ``not/and/or``, ``x if c else y``, filters ``x | f(args)``.

Sandbox: there are no calls but the listed filters, no attributes of Python objects (a dot
only looks up mapping keys), no imports and no unbounded loops.
"""
from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

END = object()            # piece that closes an iteration of an outermost loop


class TemplateError(ValueError):
    """The template's source is wrong, or asks for what the sandbox forbids."""


FILTERS: dict[str, Callable] = {
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "trim": lambda x: str(x).strip(),
    "length": len,
    "string": lambda x: _text(x),
    "default": lambda x, d="": d if x is None else x,
    "replace": lambda x, a, b: str(x).replace(str(a), str(b)),
    "join": lambda x, sep="": str(sep).join(_text(i) for i in x),
}

_SPLIT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
                    r"""|(?P<op>==|!=|<=|>=|[-+*%~<>()\[\].,|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod,
           "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne, "<": operator.lt,
           "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b,
           "not in": lambda a, b: a not in b}


def _text(x) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


def _get(x, key):
    if isinstance(x, Mapping):
        return x.get(key)
    if isinstance(x, Sequence) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


class _Expression:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        pos, end = 0, len(source.rstrip())
        while pos < end:
            m = _TOKEN.match(source, pos)
            if not m:
                raise TemplateError(f"unexpected {source[pos:pos + 10]!r}")
            pos = m.end()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self, node):
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self):
        node = self.chain(0)
        if self.take("if"):
            test = self.chain(0)
            other = self.ternary() if self.take("else") else ("const", None)
            node = ("cond", test, node, other)
        return node

    def chain(self, level: int):
        if level == 2 and self.take("not"):
            return ("not", self.chain(2))
        if level == 6:
            return self.unary()
        words = (("or",), ("and",), (), ("==", "!=", "<", "<=", ">", ">=", "in", "not"), ("~",), ("+", "-"))[level]
        if level == 2:
            return self.chain(3)
        node = self.chain(level + 1)
        while op := self.take(*words):
            if op == "not":
                self.need("in")
                op = "not in"
            right = self.chain(level + 1)
            node = (op, node, right) if op in ("or", "and") else ("bin", op, node, right)
        return node

    def unary(self):
        if self.take("-"):
            return ("bin", "-", ("const", 0), self.unary())
        node = self.postfix(self.atom())
        while op := self.take("*", "%"):
            node = ("bin", op, node, self.postfix(self.atom()))
        return node

    def atom(self):
        if self.take("("):
            node = self.ternary()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            low = value.lower()
            return ("const", {"true": True, "false": False, "none": None}[low]) \
                if low in ("true", "false", "none") else ("var", value)
        raise TemplateError(f"unexpected {value!r}")

    def postfix(self, node):
        while True:
            if self.take("."):
                node = ("get", node, ("const", self.name()))
            elif self.take("["):
                key = self.ternary()
                self.need("]")
                node = ("get", node, key)
            elif self.take("|"):
                name, args = self.name(), []
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.ternary())
                        if not self.peek(")"):
                            self.need(",")
                node = ("filter", name, node, *args)
            else:
                return node


def _parse(source: str, filters: Mapping[str, Callable]) -> list:
    parts, strip = [], False
    for i, raw in enumerate(_SPLIT.split(source)):
        if i % 2 == 0:
            raw = raw.lstrip() if strip else raw
            strip = False
            parts.append(["text", raw])
            continue
        body = raw[2:-2]
        if body.startswith("-"):
            body = body[1:]
            if parts and parts[-1][0] == "text":
                parts[-1][1] = parts[-1][1].rstrip()
        if body.endswith("-"):
            body, strip = body[:-1], True
        if raw[1] != "#":
            parts.append(["out" if raw[1] == "{" else "tag", body.strip()])
    parts = [p for p in parts if p != ["text", ""]]
    nodes, at = _block(parts, 0, (), filters)
    if at < len(parts):
        raise TemplateError(f"unexpected {parts[at][1]!r}")
    return nodes


def _expr(source: str, filters):
    e = _Expression(source, filters)
    return e.done(e.ternary())


def _block(parts: list, at: int, stops: tuple[str, ...], filters) -> tuple[list, int]:
    nodes = []
    while at < len(parts):
        kind, body = parts[at]
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "out":
            nodes.append(("out", _expr(body, filters)))
        else:
            word, _, rest = body.partition(" ")
            if word in stops:
                return nodes, at
            if word == "for":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("in")
                seq = e.done(e.ternary())
                inner, at = _block(parts, at + 1, ("endfor",), filters)
                nodes.append(("for", name, seq, inner))
            elif word == "if":
                branches, other, test = [], [], _expr(rest, filters)
                while True:
                    inner, at = _block(parts, at + 1, ("elif", "else", "endif"), filters)
                    closing, _, more = parts[at][1].partition(" ") if at < len(parts) else ("", "", "")
                    if test is None:
                        other = inner
                    else:
                        branches.append((test, inner))
                    if closing != "elif" and closing != "else":
                        break
                    test = _expr(more, filters) if closing == "elif" else None
                nodes.append(("if", branches, other))
            elif word == "set":
                e = _Expression(rest, filters)
                name = e.name()
                e.need("=")
                nodes.append(("set", name, e.done(e.ternary())))
            elif word == "generation":
                inner, at = _block(parts, at + 1, ("endgeneration",), filters)
                nodes.append(("gen", inner))
            else:
                raise TemplateError(f"unknown tag {body!r}")
            if at >= len(parts):
                raise TemplateError(f"{word!r} is not closed")
        at += 1
    return nodes, at


def _fold(node, filters):
    """The expression with constant parts computed."""
    head = node[0]
    if head in ("const", "var"):
        return node
    if head == "filter":
        node = ("filter", node[1], *[_fold(x, filters) for x in node[2:]])
        parts = node[2:]
    elif head == "bin":
        node = ("bin", node[1], _fold(node[2], filters), _fold(node[3], filters))
        parts = node[2:]
    else:
        node = (head, *[_fold(x, filters) for x in node[1:]])
        parts = node[1:]
        if head == "cond" and node[1][0] == "const":
            return node[2] if node[1][1] else node[3]
        if head in ("and", "or") and node[1][0] == "const":
            return node[2] if bool(node[1][1]) == (head == "and") else node[1]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", _closure(node, filters)({}))
        except (TypeError, ValueError, ZeroDivisionError):
            return node                                    # fails when rendered, if it is reached
    return node


def _fold_block(nodes: list, filters) -> list:
    out: list = []

    def text(value: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif value:
            out.append(("text", value))

    for n in nodes:
        if n[0] == "text":
            text(n[1])
        elif n[0] == "out":
            e = _fold(n[1], filters)
            if e[0] == "const":
                text(_text(e[1]))
            else:
                out.append(("out", e))
        elif n[0] == "set":
            out.append(("set", n[1], _fold(n[2], filters)))
        elif n[0] == "for":
            out.append(("for", n[1], _fold(n[2], filters), _fold_block(n[3], filters)))
        elif n[0] == "gen":
            out.append(("gen", _fold_block(n[1], filters)))
        else:
            kept, other = [], _fold_block(n[2], filters)
            for test, inner in n[1]:
                test, inner = _fold(test, filters), _fold_block(inner, filters)
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    other = inner
                    break
                kept.append((test, inner))
            if kept:
                out.append(("if", kept, other))
            else:
                for x in other:
                    text(x[1]) if x[0] == "text" else out.append(x)
    return out


def _closure(node, filters) -> Callable:
    head = node[0]
    if head == "const":
        return lambda env, v=node[1]: v
    if head == "var":
        return lambda env, n=node[1]: env.get(n)
    if head == "filter":
        f, args = filters[node[1]], [_closure(x, filters) for x in node[2:]]
        return lambda env: f(*[a(env) for a in args])
    if head == "bin":
        op, a, b = _BINARY[node[1]], _closure(node[2], filters), _closure(node[3], filters)
        return lambda env: op(a(env), b(env))
    a, rest = _closure(node[1], filters), [_closure(x, filters) for x in node[2:]]
    if head == "get":
        return lambda env: _get(a(env), rest[0](env))
    if head == "not":
        return lambda env: not a(env)
    if head == "and":
        return lambda env: a(env) and rest[0](env)
    if head == "or":
        return lambda env: a(env) or rest[0](env)
    return lambda env: rest[0](env) if a(env) else rest[1](env)          # cond


def _body(nodes: list, filters, gen: bool, depth: int) -> Callable:
    steps = [_step(n, filters, gen, depth) for n in nodes]

    def run(env):
        for step in steps:
            yield from step(env)
    return run


def _step(n, filters, gen: bool, depth: int) -> Callable:
    if n[0] == "text":
        piece = ((n[1], gen),)
        return lambda env: piece
    if n[0] == "out":
        e = _closure(n[1], filters)
        return lambda env: ((_text(e(env)), gen),)
    if n[0] == "gen":
        return _body(n[1], filters, True, depth)
    if n[0] == "set":
        e = _closure(n[2], filters)

        def assign(env):
            env[n[1]] = e(env)
            return ()
        return assign
    if n[0] == "if":
        branches = [(_closure(t, filters), _body(b, filters, gen, depth)) for t, b in n[1]]
        other = _body(n[2], filters, gen, depth)

        def choose(env):
            return next((b for t, b in branches if t(env)), other)(env)
        return choose
    seq, inner, name = _closure(n[2], filters), _body(n[3], filters, gen, depth + 1), n[1]

    def loop(env):
        own = dict(env)
        for i, x in enumerate(seq(env) or ()):
            own[name], own["loop"] = x, {"index0": i, "index": i + 1, "first": i == 0}
            yield from inner(own)
            if depth == 0:
                yield END, False
    return loop


class Template:
    """A compiled template. ``tree`` is the folded syntax tree."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = _fold_block(_parse(source, known), known)
        self._run = _body(self.tree, known, False, 0)

    def stream(self, env: Mapping) -> Iterator[tuple]:
        """Pieces ``(text, generated)``; ``(END, False)`` after each outermost iteration."""
        return self._run(dict(env))

    def render(self, env: Mapping) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the code-point spans of its generated parts."""
        out, spans, at = [], [], 0
        for piece, gen in self.stream(env):
            if piece is END or not piece:
                continue
            if gen:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            out.append(piece)
            at += len(piece)
        return "".join(out), spans
