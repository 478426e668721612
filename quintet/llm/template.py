"""A small sandboxed template language, compiled to Python closures.

    {{ expr }}   {% if a %}..{% elif b %}..{% else %}..{% endif %}
    {% for x in list %}..{% endfor %}   {% set x = expr %}
    {% generation %}..{% endgeneration %}   {# comment #}

Expressions: literals, names, ``a.b`` and ``a[b]`` (items of mappings and
sequences only, never attributes of objects), ``~ + - * % == != < <= > >= in
not and or``, ``a if b else c``, ``is defined``, and filters ``x | name(args)``
from a given table; nothing else can be called. In a loop ``loop.first``,
``loop.last``, ``loop.index0`` and ``loop.index`` are known. A loop reads its list lazily,
one item ahead, so it may be a stream.

``*`` and ``%`` take numbers only, and joined texts are bounded, so a short
template can't make a long text of little.

A template is parsed to a syntax tree, its constants are folded, and each
node becomes a closure. Rendering yields ``(text, generated)`` pieces;
``generated`` is true inside a generation block.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

Filters = Mapping[str, Callable[..., Any]]
Scope = dict[str, Any]

_TAG = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Characters of a text that an expression may make, and of one that is made when a template is compiled.
MOST_CHARS, FOLDED_CHARS = 1 << 28, 1 << 16


class TemplateError(ValueError):
    pass


def _joined(a: Any, b: Any) -> str:
    a, b = _text(a), _text(b)
    if len(a) + len(b) > MOST_CHARS:
        raise TemplateError(f"a text of over {MOST_CHARS} characters")
    return a + b


def _numbers(f: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    """An operator of numbers only: texts are neither repeated nor formatted, so no expression makes more than it has."""

    def run(a: Any, b: Any) -> Any:
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            raise TypeError("not a number")
        return f(a, b)

    return run


def _add(a: Any, b: Any) -> Any:
    return _joined(a, b) if isinstance(a, str) and isinstance(b, str) else _numbers(operator.add)(a, b)


_BINARY = {"+": _add, "-": _numbers(operator.sub), "*": _numbers(operator.mul), "%": _numbers(operator.mod), "~": _joined, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "%"))


class _Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


def _text(x: Any) -> str:
    return "" if x is None or x is UNDEFINED else x if isinstance(x, str) else str(x)


def _item(x: Any, key: Any) -> Any:
    """The only access there is: an item of a mapping or sequence."""
    if isinstance(x, Mapping):
        return x.get(key, UNDEFINED)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return UNDEFINED


class _Expression:
    """Recursive descent to tuples: ('const', x), ('name', n), ('item', a, b), ('binary', op, a, b), ('filter', n, args), ..."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> tuple:
        node = self.expr()
        self.end()
        return node

    def expr(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expr() if self.take("else") else ("const", UNDEFINED)
            node = ("choose", test, node, other)
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.no()
        while self.take("and"):
            node = ("and", node, self.no())
        return node

    def no(self) -> tuple:
        return ("not", self.no()) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.filtered()
        node = self.binary(level + 1)
        while True:
            if level == 0 and self.take("is"):
                inverted = bool(self.take("not"))
                self.need("defined")
                node = ("defined", node)
                node = ("not", node) if inverted else node
            elif level == 0 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = ("binary", "not in", node, self.binary(level + 1))
            elif op := self.take(*_LEVELS[level]):
                node = ("binary", op, node, self.binary(level + 1))
            else:
                return node

    def filtered(self) -> tuple:
        node = self.access()
        while self.take("|"):
            name, args = self.name(), [node]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.expr())
                    if not self.peek(")"):
                        self.need(",")
            node = ("filter", name, args)
        return node

    def access(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = ("item", node, self.expr())
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.expr()
            self.need(")")
            return node
        if self.take("-"):
            return ("binary", "-", ("const", 0), self.access())
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The statements of a template: ('text', expr), ('if', [(test, body)..], other), ('for', name, list, body), ('set', name, expr), ('generation', body)."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        pieces += [("raw", source[at : m.start()])] * (m.start() > at)
        at = m.end()
        if m[0][1] != "#":
            pieces.append((m[0][1], m[0][2:-2].strip()))
    pieces += [("raw", source[at:])] * (at < len(source))
    position = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal position
        out: list[tuple] = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "raw":
                out.append(("text", ("const", value)))
                continue
            if kind == "{":
                out.append(("text", _Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "if":
                tests, other = [], []
                test = _Expression(rest).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    tests.append((test, inner))
                    if end.startswith("elif"):
                        test = _Expression(end[4:]).whole()
                        continue
                    if end == "else":
                        other, end = body("endif")
                    break
                out.append(("if", tests, other))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                out.append(("for", name, e.whole(), body("endfor")[0]))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.need("=")
                out.append(("set", name, e.whole()))
            elif word == "generation":
                out.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    return body()[0]


def _worked_out(value: Callable[[], Any], node: tuple) -> tuple:
    """A constant, or the node as it is if its value is too long, or fails: then it fails when it is rendered, if it is."""
    try:
        x = value()
    except (TypeError, ValueError, ArithmeticError, LookupError, AttributeError):
        return node
    return node if isinstance(x, str) and len(x) > FOLDED_CHARS else ("const", x)


def _fold_expression(node: tuple, filters: Filters) -> tuple:
    """The same expression with what only depends on constants worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        args = [_fold_expression(a, filters) for a in node[2]]
        if all(a[0] == "const" for a in args):
            return _worked_out(lambda: filters[node[1]](*(a[1] for a in args)), ("filter", node[1], args))
        return ("filter", node[1], args)
    if kind == "binary":
        a, b = (_fold_expression(x, filters) for x in node[2:])
        if a[0] == b[0] == "const":
            return _worked_out(lambda: _BINARY[node[1]](a[1], b[1]), ("binary", node[1], a, b))
        return ("binary", node[1], a, b)
    parts = [_fold_expression(x, filters) for x in node[1:]]
    first = parts[0]
    if first[0] == "const":
        if kind == "not":
            return ("const", not first[1])
        if kind == "defined":
            return ("const", first[1] is not UNDEFINED)
        if kind == "choose":
            return parts[1] if first[1] else parts[2]
        if kind in ("and", "or"):
            return parts[1] if bool(first[1]) == (kind == "and") else first
        if kind == "item" and parts[1][0] == "const":
            return ("const", _item(first[1], parts[1][1]))
    return (kind, *parts)


def fold(body: list[tuple], filters: Filters) -> list[tuple]:
    """Fold expressions, drop branches that can't be taken, and join neighbouring constant texts."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and node[1][0] == "const":
            text = _text(node[1][1])
            if out and out[-1][0] == "text" and out[-1][1][0] == "const":
                text = out.pop()[1][1] + text
            if text:
                out.append(("text", ("const", text)))
        else:
            out.append(node)

    for node in body:
        if node[0] == "text":
            add(("text", _fold_expression(node[1], filters)))
        elif node[0] == "set":
            add(("set", node[1], _fold_expression(node[2], filters)))
        elif node[0] == "for":
            add(("for", node[1], _fold_expression(node[2], filters), fold(node[3], filters)))
        elif node[0] == "generation":
            add(("generation", fold(node[1], filters)))
        else:
            tests, other = [], node[2]
            for test, inner in node[1]:
                test = _fold_expression(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                if test[0] == "const":
                    other = inner
                    break
                tests.append((test, fold(inner, filters)))
            other = fold(other, filters)
            if tests:
                add(("if", tests, other))
            else:
                for x in other:
                    add(x)
    return out


def _expression(node: tuple, filters: Filters) -> Callable[[Scope], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda s: value
    if kind == "name":
        name = node[1]
        return lambda s: s.get(name, UNDEFINED)
    if kind == "filter":
        f, args = filters[node[1]], [_expression(a, filters) for a in node[2]]
        if len(args) == 1:
            only = args[0]
            return lambda s: f(only(s))
        return lambda s: f(*(a(s) for a in args))
    if kind == "binary":
        op, a, b = _BINARY[node[1]], _expression(node[2], filters), _expression(node[3], filters)
        return lambda s: op(a(s), b(s))
    parts = [_expression(x, filters) for x in node[1:]]
    a = parts[0]
    if kind == "not":
        return lambda s: not a(s)
    if kind == "defined":
        return lambda s: a(s) is not UNDEFINED
    b = parts[1]
    if kind == "and":
        return lambda s: a(s) and b(s)
    if kind == "or":
        return lambda s: a(s) or b(s)
    if kind == "item":
        return lambda s: _item(a(s), b(s))
    c = parts[2]
    return lambda s: b(s) if a(s) else c(s)


Pieces = Iterator[tuple[str, bool]]


def _statements(body: list[tuple], filters: Filters, generated: bool) -> Callable[[Scope], Pieces]:
    runs = [_statement(x, filters, generated) for x in body]

    def run(s: Scope) -> Pieces:
        for r in runs:
            yield from r(s)

    return run


def _statement(node: tuple, filters: Filters, generated: bool) -> Callable[[Scope], Pieces]:
    kind = node[0]
    if kind == "text":
        if node[1][0] == "const":
            piece = (node[1][1], generated)
            return lambda s: iter((piece,))
        value = _expression(node[1], filters)

        def write(s: Scope) -> Pieces:
            if text := _text(value(s)):
                yield text, generated

        return write
    if kind == "set":
        name, value = node[1], _expression(node[2], filters)

        def put(s: Scope) -> Pieces:
            s[name] = value(s)
            return iter(())

        return put
    if kind == "generation":
        return _statements(node[1], filters, True)
    if kind == "if":
        tests = [(_expression(t, filters), _statements(b, filters, generated)) for t, b in node[1]]
        other = _statements(node[2], filters, generated)

        def choose(s: Scope) -> Pieces:
            for test, inner in tests:
                if test(s):
                    yield from inner(s)
                    return
            yield from other(s)

        return choose
    name, values, inner = node[1], _expression(node[2], filters), _statements(node[3], filters, generated)

    def loop(s: Scope) -> Pieces:
        items = values(s)
        if items is None or items is UNDEFINED:
            return
        items, own = iter(items), dict(s)
        end = object()
        item, k = next(items, end), 0
        while item is not end:
            after = next(items, end)
            own[name] = item
            own["loop"] = {"first": k == 0, "last": after is end, "index0": k, "index": k + 1}
            yield from inner(own)
            item, k = after, k + 1

    return loop


def compile_template(source: str, filters: Filters | None = None) -> Callable[..., Pieces]:
    """A function of the template's variables that yields ``(text, generated)`` pieces."""
    filters = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len} | dict(filters or {})
    run = _statements(fold(parse(source), filters), filters, False)
    return lambda **scope: run(dict(scope))


def render(source: str, filters: Filters | None = None, **scope: Any) -> str:
    return "".join(text for text, _ in compile_template(source, filters)(**scope))


def marked(pieces: Iterable[tuple[str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans of its code points that are generated."""
    out, spans, at = [], [], 0
    for text, generated in pieces:
        out.append(text)
        if generated:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)
    return "".join(out), spans
