"""Chat formatting with a compiled template language.

A template is tokenised, parsed into a syntax tree, its constants are folded,
and the tree becomes nested Python closures. The language has no way to
Python: names are looked up in the context alone, attributes are keys of
mappings, there are no calls but of a fixed set of functions and methods and
of the template's own macros, and work is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.session import ship_code

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + m.role + '\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ (m.content | trim) + '<|im_end|>' }}{% endgeneration %}{{ '\n' }}"
    "{% else %}{{ (m.content | trim) + '<|im_end|>\n' }}{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    """The template is wrong, or refuses its input."""


class Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = Undefined()

# Tokens

_OPEN = re.compile(r"\{\{|\{%|\{#")
_LEX = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+~*/%<>=()\[\]{}.,:|]))""", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text: {source[at : at + 20]!r}")
        at = m.end()
        if m["num"]:
            out.append(("const", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"]:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPE.get(e[1], e[0]), m["str"][1:-1], flags=re.S)))
        elif m["name"]:
            out.append(("name", m["name"]))
        else:
            out.append(("op", m["op"]))
    return [*out, ("end", None)]


def _end_of_tag(source: str, at: int, close: str) -> int:
    """Where ``close`` stands outside of strings and of braces that the tag opened itself."""
    depth = 0
    while at < len(source):
        c = source[at]
        if depth == 0 and source.startswith(close, at):
            return at
        if c in "'\"":
            at += 1
            while at < len(source) and source[at] != c:
                at += 2 if source[at] == "\\" else 1
        elif c in "{[(":
            depth += 1
        elif c in "}])":
            depth = max(0, depth - 1)
        at += 1
    raise TemplateError(f"no {close}")


def split(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list[tuple[str, Any]]:
    """("text", s), ("expr", tokens) and ("tag", tokens), with the whitespace that dashes ask for taken away.

    ``trim_blocks``: the first line feed after a tag or comment goes;
    ``lstrip_blocks``: so do blanks between a line's start and a tag or comment.
    """
    out: list[tuple[str, Any]] = []
    at, strip, trim = 0, False, False
    while True:
        m = _OPEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        elif trim and text.startswith("\n"):
            text = text[1:]
        if not m:
            out.append(("text", text))
            return out
        kind, begin = m[0], m.end()
        end = source.find("#}", begin) if kind == "{#" else _end_of_tag(source, begin, {"{{": "}}", "{%": "%}"}[kind])
        if end < 0:
            raise TemplateError("no #}")
        inner = source[begin:end]
        if inner[:1] == "-":
            text = text.rstrip()
        elif lstrip_blocks and kind != "{{" and inner[:1] != "+":
            line = m.start()
            while line > at and source[line - 1] in " \t":
                line -= 1
            if line == 0 or source[line - 1] == "\n":
                text = text[: max(0, len(text) - (m.start() - line))]
        out.append(("text", text))
        strip = inner[-1:] == "-"
        trim = trim_blocks and kind != "{{"
        inner = inner[inner[:1] in ("-", "+") and len(inner) > 0 : len(inner) - strip]
        if kind == "{{":
            out.append(("expr", lex(inner)))
        elif kind == "{%":
            out.append(("tag", lex(inner)))
        at = end + 2


# Syntax tree


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()


_BINARY = {"+": 3, "-": 3, "~": 3, "*": 4, "/": 4, "//": 4, "%": 4}
_COMPARE = ("==", "!=", "<", ">", "<=", ">=")


class _Expression:
    def __init__(self, tokens: list[tuple[str, Any]], at: int = 0):
        self.tokens, self.at = tokens, at

    def peek(self, *ops: str) -> bool:
        kind, v = self.tokens[self.at]
        return kind in ("op", "name") and v in ops

    def take(self, *ops: str) -> str:
        if not self.peek(*ops):
            raise TemplateError(f"expected {' or '.join(ops)}, not {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, v = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"expected a name, not {v!r}")
        self.at += 1
        return v

    def done(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> Node:
        x = self.either()
        if self.peek("if"):
            self.at += 1
            test = self.either()
            other = Node("const", "")
            if self.peek("else"):
                self.at += 1
                other = self.expression()
            return Node("choose", None, (test, x, other))
        return x

    def either(self) -> Node:
        x = self.both()
        while self.peek("or"):
            self.at += 1
            x = Node("or", None, (x, self.both()))
        return x

    def both(self) -> Node:
        x = self.negated()
        while self.peek("and"):
            self.at += 1
            x = Node("and", None, (x, self.negated()))
        return x

    def negated(self) -> Node:
        if self.peek("not"):
            self.at += 1
            return Node("not", None, (self.negated(),))
        return self.comparison()

    def comparison(self) -> Node:
        x = self.binary(3)
        while True:
            if self.peek(*_COMPARE):
                op = self.take(*_COMPARE)
                x = Node("compare", op, (x, self.binary(3)))
            elif self.peek("in"):
                self.at += 1
                x = Node("in", None, (x, self.binary(3)))
            elif self.peek("not") and self.tokens[self.at + 1] == ("name", "in"):
                self.at += 2
                x = Node("not", None, (Node("in", None, (x, self.binary(3))),))
            elif self.peek("is"):
                self.at += 1
                no = self.peek("not")
                self.at += no
                test = self.name()
                if test not in _TESTS:
                    raise TemplateError(f"no test {test}")
                more = ()
                if test in _TESTS_OF_TWO:
                    more = tuple(self.arguments()[0]) if self.peek("(") else (self.binary(3),)
                x = Node("is", test, (x, *more))
                x = Node("not", None, (x,)) if no else x
            else:
                return x

    def binary(self, level: int) -> Node:
        if level > 4:
            return self.unary()
        x = self.binary(level + 1)
        while self.tokens[self.at][0] == "op" and _BINARY.get(self.tokens[self.at][1]) == level:
            op = self.tokens[self.at][1]
            self.at += 1
            x = Node("binary", op, (x, self.binary(level + 1)))
        return x

    def unary(self) -> Node:
        if self.peek("-"):
            self.at += 1
            return Node("minus", None, (self.unary(),))
        return self.postfix(self.atom())

    def atom(self) -> Node:
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Node("const", v)
        if kind == "name":
            if v.lower() in ("true", "false", "none"):
                return Node("const", {"true": True, "false": False, "none": None}[v.lower()])
            if self.peek("("):
                values, names = self.arguments()
                return Node("call", (v, names), tuple(values))
            return Node("name", v)
        if v == "(":
            x = self.expression()
            self.take(")")
            return x
        if v == "[":
            items = []
            while not self.peek("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.take(",")
            self.take("]")
            return Node("list", None, tuple(items))
        if v == "{":
            pairs = []
            while not self.peek("}"):
                pairs.append(self.expression())
                self.take(":")
                pairs.append(self.expression())
                if not self.peek("}"):
                    self.take(",")
            self.take("}")
            return Node("dict", None, tuple(pairs))
        raise TemplateError(f"unexpected {v!r}")

    def arguments(self) -> tuple[list[Node], tuple[str, ...]]:
        """The values, those with a name last, and the names."""
        self.take("(")
        values: list[Node] = []
        names: list[str] = []
        while not self.peek(")"):
            if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                names.append(self.name())
                self.take("=")
            elif names:
                raise TemplateError("a value without a name after one with a name")
            values.append(self.expression())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return values, tuple(names)

    def postfix(self, x: Node) -> Node:
        while True:
            if self.peek("."):
                self.at += 1
                k = self.name()
                if self.peek("("):
                    values, names = self.arguments()
                    if k not in _METHODS:
                        raise TemplateError(f"no method {k}")
                    x = Node("method", (k, names), (x, *values))
                else:
                    x = Node("item", None, (x, Node("const", k)))
            elif self.peek("["):
                self.at += 1
                bounds: list[Node | None] = [None]
                sliced = False
                while not self.peek("]"):
                    if self.peek(":"):
                        self.at += 1
                        sliced = True
                        bounds.append(None)
                    else:
                        bounds[-1] = self.expression()
                self.take("]")
                if len(bounds) > 3 or (not sliced and bounds[0] is None):
                    raise TemplateError("a wrong subscript")
                x = Node("slice", None, (x, *(b or Node("const", None) for b in [*bounds, None, None][:3]))) if sliced else Node("item", None, (x, bounds[0]))
            elif self.peek("|"):
                self.at += 1
                f = self.name()
                if f not in _FILTERS:
                    raise TemplateError(f"no filter {f}")
                values, names = self.arguments() if self.peek("(") else ([], ())
                x = Node("filter", (f, names), (x, *values))
            else:
                return x


class _Template:
    def __init__(self, pieces: list[tuple[str, Any]]):
        self.pieces, self.at = pieces, 0

    def block(self, *ends: str) -> tuple[Node, str, list]:
        """The nodes up to one of the tags ``ends``, that tag, and its tokens."""
        out = []
        while self.at < len(self.pieces):
            kind, v = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                if v:
                    out.append(Node("text", v))
            elif kind == "expr":
                e = _Expression(v)
                out.append(Node("put", None, (e.expression(),)))
                e.done()
            else:
                word = v[0][1]
                if word in ends:
                    return Node("block", None, tuple(out)), word, v
                out.append(self.tag(word, v))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return Node("block", None, tuple(out)), "", []

    def tag(self, word: str, tokens: list) -> Node:
        e = _Expression(tokens, 1)
        if word == "for":
            names = [e.name()]
            while e.peek(","):
                e.at += 1
                names.append(e.name())
            e.take("in")
            over = e.either()
            test = Node("const", True)
            if e.peek("if"):
                e.at += 1
                test = e.expression()
            e.done()
            body, end, _ = self.block("else", "endfor")
            other = Node("block")
            if end == "else":
                other, _, _ = self.block("endfor")
            return Node("for", tuple(names), (over, test, body, other))
        if word == "if":
            test = e.expression()
            e.done()
            body, end, more = self.block("elif", "else", "endif")
            if end == "elif":
                return Node("if", None, (test, body, self.tag("if", more)))
            other = Node("block")
            if end == "else":
                other, _, _ = self.block("endif")
            return Node("if", None, (test, body, other))
        if word == "set":
            name, field_ = e.name(), None
            if e.peek("."):
                e.at += 1
                field_ = e.name()
            if not field_ and e.tokens[e.at][0] == "end":
                body, _, _ = self.block("endset")
                return Node("capture", name, (body,))
            e.take("=")
            value = e.expression()
            e.done()
            return Node("set", (name, field_), (value,))
        if word == "macro":
            name = e.name()
            e.take("(")
            names, given = [], []
            while not e.peek(")"):
                names.append(e.name())
                if e.peek("="):
                    e.at += 1
                    given.append(e.expression())
                elif given:
                    raise TemplateError("a parameter without a value after one with a value")
                if not e.peek(")"):
                    e.take(",")
            e.take(")")
            e.done()
            body, _, _ = self.block("endmacro")
            return Node("macro", (name, tuple(names)), (*given, body))
        if word == "generation":
            e.done()
            body, _, _ = self.block("endgeneration")
            return Node("generation", None, (body,))
        raise TemplateError(f"no tag {word}")


def parse(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> Node:
    return _Template(split(source, trim_blocks, lstrip_blocks)).block()[0]


# Meaning

#: Characters and loop steps that a template may make besides what its input accounts for.
LONGEST = 50_000_000
MOST_STEPS = 10_000_000
#: Characters that the input of the running template accounts for.
_GIVEN: ContextVar[int] = ContextVar("given", default=0)
#: Loop steps and macro calls of the running template.
_STEPS: ContextVar[list[int]] = ContextVar("steps")


def _step() -> None:
    steps = _STEPS.get(None)
    if steps is None:  # a constant is being folded
        return
    steps[0] += 1
    if steps[0] > MOST_STEPS + _GIVEN.get() // 1000 * 4:
        raise TemplateError("too many steps")


def _given(x: Any) -> int:
    """Four times the input's characters, and 1,000 for each entry and message."""
    if isinstance(x, str):
        return 4 * len(x)
    if isinstance(x, dict):
        return sum(1000 + _given(y) for y in x.values())
    if isinstance(x, (list, tuple)):
        return sum(1000 + _given(y) for y in x)
    return 0


def _longest() -> int:
    return LONGEST + _GIVEN.get()


def _text(x: Any) -> str:
    if x is None:
        return "None"
    if x is UNDEFINED:
        return ""
    return x if isinstance(x, str) else str(x)


def _sized(x: Any) -> Any:
    if isinstance(x, (str, list)) and len(x) > _longest():
        raise TemplateError("a value grew too long")
    return x


def _times(a: Any, b: Any) -> Any:
    if isinstance(a, (str, list)) and isinstance(b, int) and len(a) * b > _longest():
        raise TemplateError("a value grew too long")
    return a * b


_OPS: dict[str, Callable] = {"+": lambda a, b: _sized(a + b), "-": lambda a, b: a - b, "~": lambda a, b: _sized(_text(a) + _text(b)), "*": _times, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b if not isinstance(a, str) else _no_format()}
_CMP: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
_TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "mapping": lambda x: isinstance(x, dict), "sequence": lambda x: isinstance(x, (str, list)),
    "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "boolean": lambda x: isinstance(x, bool), "float": lambda x: isinstance(x, float),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "iterable": lambda x: isinstance(x, (str, list, dict)), "lower": lambda x: _text(x).islower(), "upper": lambda x: _text(x).isupper(),
    "equalto": lambda x, y: x == y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "in": lambda x, y: x in y, "sameas": lambda x, y: x is y or x == y and type(x) is type(y), "divisibleby": lambda x, y: x % y == 0,
}
_TESTS_OF_TWO = {"equalto", "eq", "ne", "in", "sameas", "divisibleby"}
_FILTERS: dict[str, Callable] = {
    "trim": lambda x, *c: _text(x).strip(*c), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "capitalize": lambda x: _text(x).capitalize(), "title": lambda x: _text(x).title(),
    "length": len, "count": len, "first": lambda x: x[0] if x else UNDEFINED, "last": lambda x: x[-1] if x else UNDEFINED, "join": lambda x, sep="": _sized(sep.join(_text(y) for y in x)),
    "default": lambda x, d="", falsy=False: d if x is UNDEFINED or (falsy and not x) else x, "replace": lambda x, a, b, count=-1: _replaced(_text(x), a, b, count) if a else x, "string": _text,
    "int": lambda x: int(x), "float": lambda x: float(x), "abs": abs, "tojson": lambda x, indent=None: _sized(json.dumps(x, ensure_ascii=False, indent=indent)), "reverse": lambda x: x[::-1], "list": lambda x: list(x), "safe": _text, "min": lambda x: min(x, default=UNDEFINED),
    "max": lambda x: max(x, default=UNDEFINED), "sum": lambda x: sum(x), "sort": lambda x, reverse=False: sorted(x, reverse=reverse), "unique": lambda x: list({_key(y): y for y in reversed(x)}.values())[::-1], "items": lambda x: [[k, v] for k, v in x.items()],
    "dictsort": lambda x: [[k, x[k]] for k in sorted(x)], "indent": lambda x, width=4, first=False: _sized(_indent(_text(x), " " * width, first)), "map": lambda x, f=None, attribute=None: [_item(y, attribute) for y in x] if attribute is not None else [_FILTERS[f](y) for y in x],
    "selectattr": lambda x, a, test=None, *v: [y for y in x if _passes(_item(y, a), test, v)], "rejectattr": lambda x, a, test=None, *v: [y for y in x if not _passes(_item(y, a), test, v)],
    "select": lambda x, test=None, *v: [y for y in x if _passes(y, test, v)], "reject": lambda x, test=None, *v: [y for y in x if not _passes(y, test, v)],
}


def _key(x: Any) -> Any:
    return json.dumps(x, sort_keys=True, default=str) if isinstance(x, (dict, list)) else x


def _indent(x: str, by: str, first: bool) -> str:
    head, *rest = x.split("\n")
    return "\n".join([by + head if first else head, *[by + y if y else y for y in rest]])


def _passes(x: Any, test: str | None, v: tuple) -> bool:
    return bool(_TESTS[test](x, *v) if test is not None else x is not UNDEFINED and x)


def _of(kind: type, name: str, result: Callable = lambda x: x) -> Callable:
    def run(x: Any, *a: Any, **k: Any) -> Any:
        if not isinstance(x, kind):
            raise TemplateError(f"no method {name} of this value")
        return _sized(result(getattr(kind, name)(x, *a, **k)))

    return run


#: Methods by name; each looks at what it is called on, and there are no others.
_METHODS: dict[str, Callable] = {name: _of(str, name) for name in "strip lstrip rstrip upper lower title capitalize startswith endswith split rsplit splitlines find removeprefix removesuffix isdigit isalpha isspace isupper islower".split()}
_METHODS |= {"items": _of(dict, "items", lambda x: [list(y) for y in x]), "keys": _of(dict, "keys", list), "values": _of(dict, "values", list), "get": lambda x, k, d=None: x.get(k, d) if isinstance(x, dict) else _raise("no method get of this value")}
_METHODS |= {"replace": lambda x, a, b, n=-1: _replaced(x, a, b, n), "join": lambda x, items: _sized(x.join(_text(y) for y in items)) if isinstance(x, str) else _raise("no method join of this value"), "count": lambda x, y: x.count(y) if isinstance(x, (str, list)) else _raise("no method count of this value"), "index": lambda x, y: x.index(y) if isinstance(x, (str, list)) else _raise("no method index of this value")}


def _replaced(x: Any, a: str, b: str, n: int) -> str:
    if not isinstance(x, str):
        raise TemplateError("no method replace of this value")
    times = x.count(a) if n < 0 else min(n, x.count(a))
    if len(x) + times * (len(b) - len(a)) > _longest():
        raise TemplateError("a value grew too long")
    return x.replace(a, b, n)


def _no_format() -> Any:
    raise TemplateError("strings have no % here")


def _raise(message: str = "") -> Any:
    raise TemplateError(message)


def _range(*bounds: int) -> list[int]:
    r = range(*bounds)
    if len(r) > MOST_STEPS + _GIVEN.get() // 1000 * 4:
        raise TemplateError("a range is too long")
    return list(r)


class Namespace(dict):
    """What ``namespace()`` makes: its fields can be set from within loops."""


_CALLS: dict[str, Callable] = {"raise_exception": _raise, "range": _range, "namespace": lambda *a, **k: Namespace(*a, **k), "dict": lambda *a, **k: dict(*a, **k)}
_PURE = {"minus", "not", "compare", "binary", "in", "is", "and", "or", "choose", "filter", "slice", "item", "method"}


def fold(n: Node) -> Node:
    """The tree with constant parts computed, branches that can't be taken left out, and texts joined."""
    parts = tuple(fold(p) for p in n.parts)
    n = Node(n.kind, n.value, parts)
    if n.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for x in p.parts if p.kind == "block" else (p,):
                if x.kind == "put" and x.parts[0].kind == "const":
                    x = Node("text", _text(x.parts[0].value))
                if x.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + x.value)
                elif x.kind != "text" or x.value:
                    flat.append(x)
        return Node("block", None, tuple(flat))
    if n.kind in ("if", "choose") and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if n.kind in _PURE and all(p.kind == "const" for p in parts):
        try:
            return Node("const", _expression(n)({}))
        except Exception:  # left for the time the template runs, if that place is reached
            return n
    return n


def _item(a: Any, k: Any) -> Any:
    if isinstance(a, dict):
        return a.get(k, UNDEFINED)
    if isinstance(a, (list, str)) and isinstance(k, int) and not isinstance(k, bool):
        return a[k] if -len(a) <= k < len(a) else UNDEFINED
    if a is UNDEFINED:
        raise TemplateError(f"{k!r} of an undefined value")
    return UNDEFINED


def _calling(f: Callable[[dict], Callable], p: list[Callable], names: tuple[str, ...]) -> Callable[[dict], Any]:
    if not names:
        return lambda c: f(c)(*[x(c) for x in p])
    plain, named = p[: len(p) - len(names)], p[len(p) - len(names) :]
    return lambda c: f(c)(*[x(c) for x in plain], **{k: x(c) for k, x in zip(names, named)})


class Macro:
    """A macro: called with values, it gives its text."""

    def __init__(self, names: tuple[str, ...], given: list[Callable], body: Callable, scope: dict):
        self.names, self.given, self.body, self.scope = names, given, body, scope

    def __call__(self, *values: Any, **named: Any) -> str:
        _step()
        if len(values) > len(self.names) or set(named) - set(self.names):
            raise TemplateError("a macro has no such parameter")
        c = dict(self.scope)
        first = len(self.names) - len(self.given)
        for i, k in enumerate(self.names):
            c[k] = values[i] if i < len(values) else named[k] if k in named else self.given[i - first](c) if i >= first else UNDEFINED
        out = Out()
        self.body(c, out)
        if out.spans:
            raise TemplateError("generation within a macro")
        return "".join(out.parts)


def _expression(n: Node) -> Callable[[dict], Any]:
    """A closure from a context to the node's value."""
    kind, v = n.kind, n.value
    if kind == "const":
        return lambda c: v
    if kind == "name":
        return lambda c: c.get(v, UNDEFINED)
    p = [_expression(x) for x in n.parts]
    if kind == "item":
        a, k = p
        return lambda c: _item(a(c), k(c))
    if kind == "slice":
        a, lo, hi, by = p
        return lambda c: a(c)[slice(lo(c), hi(c), by(c))]
    if kind == "filter":
        f, names = _FILTERS[v[0]], v[1]
        a, rest = p[0], p[1:]
        return _calling(lambda c: f, p, names) if rest else (lambda c: f(a(c)))
    if kind == "method":
        f = _METHODS[v[0]]
        return _calling(lambda c: f, p, v[1])
    if kind == "call":
        name, names = v
        f = _CALLS.get(name)

        def called(c: dict) -> Callable:
            own = c.get(name)
            if isinstance(own, Macro):
                return own
            if f is None:
                raise TemplateError(f"no function {name}")
            return f

        return _calling(called, p, names)
    if kind == "list":
        return lambda c: [x(c) for x in p]
    if kind == "dict":
        return lambda c: {k(c): x(c) for k, x in zip(p[::2], p[1::2])}
    if kind == "choose":
        test, yes, no = p
        return lambda c: yes(c) if test(c) else no(c)
    if kind == "is":
        f, a = _TESTS[v], p[0]
        return (lambda c: f(*[x(c) for x in p])) if len(p) > 1 else (lambda c: f(a(c)))
    if kind == "not":
        a = p[0]
        return lambda c: not a(c)
    if kind == "minus":
        a = p[0]
        return lambda c: -a(c)
    a, b = p
    if kind == "and":
        return lambda c: a(c) and b(c)
    if kind == "or":
        return lambda c: a(c) or b(c)
    if kind == "in":
        return lambda c: a(c) in b(c)
    f = _OPS[v] if kind == "binary" else _CMP[v]
    return lambda c: f(a(c), b(c))


class Out:
    """The text so far, and where generated parts begin and end."""

    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)
        if self.size > _longest():
            raise TemplateError("the output grew too long")


def _statement(n: Node) -> Callable[[dict, Out], None]:
    kind = n.kind
    if kind == "text":
        s = n.value
        return lambda c, o: o.put(s)
    if kind == "put":
        e = _expression(n.parts[0])
        return lambda c, o: o.put(_text(e(c)))
    if kind == "block":
        steps = [_statement(x) for x in n.parts]
        if len(steps) == 1:
            return steps[0]

        def block(c: dict, o: Out) -> None:
            for s in steps:
                s(c, o)

        return block
    if kind == "if":
        test, yes, no = _expression(n.parts[0]), _statement(n.parts[1]), _statement(n.parts[2])
        return lambda c, o: yes(c, o) if test(c) else no(c, o)
    if kind == "set":
        (name, key), e = n.value, _expression(n.parts[0])
        if key is None:
            return lambda c, o: c.__setitem__(name, e(c))

        def set_field(c: dict, o: Out) -> None:
            if not isinstance(c.get(name), Namespace):
                raise TemplateError(f"{name} is no namespace")
            c[name][key] = e(c)

        return set_field
    if kind == "capture":
        name, body = n.value, _statement(n.parts[0])

        def capture(c: dict, o: Out) -> None:
            inner = Out()
            body(c, inner)
            if inner.spans:
                raise TemplateError("generation within set")
            c[name] = "".join(inner.parts)

        return capture
    if kind == "macro":
        (name, names), given, body = n.value, [_expression(x) for x in n.parts[:-1]], _statement(n.parts[-1])
        return lambda c, o: c.__setitem__(name, Macro(names, given, body, c))
    if kind == "generation":
        body = _statement(n.parts[0])

        def generation(c: dict, o: Out) -> None:
            start = o.size
            body(c, o)
            o.spans.append((start, o.size))

        return generation
    if kind != "for":
        raise TemplateError(f"{kind} is no statement")
    names, over, test, body, other = n.value, _expression(n.parts[0]), _expression(n.parts[1]), _statement(n.parts[2]), _statement(n.parts[3])

    def loop(c: dict, o: Out) -> None:
        items = over(c)
        if items is UNDEFINED or items is None:
            items = []
        inner = dict(c)
        picked = []
        for x in items:
            _bind(inner, names, x)
            if test(inner):
                picked.append(x)
        for i, x in enumerate(picked):
            _step()
            _bind(inner, names, x)
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(picked), "length": len(picked), "revindex0": len(picked) - 1 - i, "previtem": picked[i - 1] if i else UNDEFINED, "nextitem": picked[i + 1] if i + 1 < len(picked) else UNDEFINED}
            body(inner, o)
        if not picked:
            other(c, o)

    return loop


def _bind(c: dict, names: tuple[str, ...], x: Any) -> None:
    if len(names) == 1:
        c[names[0]] = x
    else:
        if len(x) != len(names):
            raise TemplateError(f"{len(names)} names for {len(x)} values")
        for k, v in zip(names, x):
            c[k] = v


@dataclass
class Template:
    """A compiled template; ``render`` gives the text and the spans of its generated parts."""

    source: str
    trim_blocks: bool = False
    lstrip_blocks: bool = False
    tree: Node = field(init=False)

    def __post_init__(self) -> None:
        self.tree = fold(parse(self.source, self.trim_blocks, self.lstrip_blocks))
        self._run = _statement(self.tree)

    def render(self, **context: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        token, steps = _GIVEN.set(_given(context)), _STEPS.set([0])
        try:
            self._run(dict(context), out)
        except TemplateError:
            raise
        except (TypeError, ValueError, IndexError, KeyError, ZeroDivisionError, AttributeError, RecursionError) as e:
            raise TemplateError(f"{type(e).__name__}: {e}") from None
        finally:
            _GIVEN.reset(token)
            _STEPS.reset(steps)
        return "".join(out.parts), out.spans


RENDERED = "conv_id long, n_messages long, text string, generated array<struct<start: int, end: int>>, error string"


def format_conversations(
    turns: DataFrame, template: str = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context: dict[str, Any] | None = None, trim_blocks: bool = False, lstrip_blocks: bool = False
) -> DataFrame:
    """One row per conversation: the rendered text, the spans of generated parts in its characters, or the template's error.

    A template sees ``messages``, ``bos_token`` and ``eos_token`` (empty),
    ``tools`` (none) and ``add_generation_prompt`` (false), and what
    ``context`` gives instead of these or besides.

    Messages are ordered by turn, then role, then text, nulls first; repeated
    rows are repeated messages. A null role reads as ``unknown``, a null text
    as empty; rows with a null conv_id make one conversation. Texts of any
    length are rendered whole. Only these four columns are read; an empty
    table gives no conversations. A wrong template fails at once, on the
    driver.
    """
    Template(template, trim_blocks, lstrip_blocks)
    known = {"bos_token": "", "eos_token": "", "tools": None, "add_generation_prompt": False} | (context or {})
    ship_code(turns.sparkSession)
    message = F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("content"))
    grouped = turns.select(F.col(f"`{conv_id}`").cast("string").alias("conv_id"), message.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Template(template, trim_blocks, lstrip_blocks)
        for pdf in batches:
            rows = []
            for k, messages in zip(pdf["conv_id"], pdf["messages"]):
                ms = [{"role": m["role"], "content": m["content"]} for m in messages]
                try:
                    s, spans = t.render(**known | {"messages": ms})
                    rows.append((k, len(ms), s, [{"start": a, "end": b} for a, b in spans], None))
                except TemplateError as e:
                    rows.append((k, len(ms), None, [], str(e)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_messages", "text", "generated", "error"])
            yield out

    return grouped.mapInPandas(run, RENDERED.replace("conv_id long", "conv_id string")).withColumn("conv_id", F.col("conv_id").cast("long"))


def chatml_sql() -> str:
    """What ``format_conversations`` gives with CHATML, for DuckDB; spans as start:end, joined by commas."""
    return """
    WITH m AS (SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) AS head, trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '<|im_end|>' AS body, text FROM conversations),
    o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM m)
    SELECT conv_id, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS text,
      coalesce(string_agg((before + length(head))::VARCHAR || ':' || (before + length(head) + length(body))::VARCHAR, ',' ORDER BY before) FILTER (role = 'assistant'), '') AS generated
    FROM o GROUP BY conv_id"""
