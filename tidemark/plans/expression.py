"""A formula language that compiles to one Catalyst column.

Numbers; attributes as |Name, 'Name' or "Name"; tags as tag('Name'); functions; ^ (binds to the right), unary
- and !, * / %, + -, comparisons, == !=, && (AND), || (OR), in that order.
Comparisons and logic give 1.0 or 0.0. Division and remainder by 0 are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|\|(?P<attr>[A-Za-z_]\w*)|'(?P<quoted>[^']+)'|"(?P<double>[^"]+)"|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%^!<>(),])|(?P<word>[A-Za-z_]\w*))""")


class FormulaError(ValueError):
    """A formula that does not parse."""


def _mean(*x: Column) -> Column:
    total = x[0]
    for y in x[1:]:
        total = total + y
    return total / len(x)


#: Name in lower case: least and most arguments, and the column they give.
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs), "sqrt": (1, 1, lambda x: F.when(x >= 0, F.sqrt(x))), "ln": (1, 1, lambda x: F.when(x > 0, F.ln(x))), "exp": (1, 1, lambda x: F.when(x <= 700, F.exp(x))),
    "sin": (1, 1, F.sin), "cos": (1, 1, F.cos), "tan": (1, 1, F.tan), "round": (1, 1, lambda x: F.round(x, 0)), "ceil": (1, 1, lambda x: F.ceil(x).cast("double")), "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "pow": (2, 2, lambda x, y: F.when((x >= 0) | (y == F.floor(y)), F.pow(x, y))),
    "min": (1, 8, lambda *x: F.least(*x) if len(x) > 1 else x[0]), "max": (1, 8, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]),
    "tagmin": (1, 8, lambda *x: F.least(*x) if len(x) > 1 else x[0]), "tagmax": (1, 8, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]), "tagavg": (1, 8, _mean),
    "if": (3, 3, lambda c, a, b: F.when(c != 0, a).otherwise(b)),
}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:].strip()[:10]!r} at {at}")
        kind = m.lastgroup
        word = m[kind]
        if kind == "word" and word.upper() in ("AND", "OR", "NOT"):
            kind, word = "op", {"AND": "&&", "OR": "||", "NOT": "!"}[word.upper()]
        out.append(("attr" if kind in ("quoted", "double") else kind, word))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, attribute: Callable[[str], Column]):
        self.tokens, self.at, self.attribute = tokenize(text), 0, attribute

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FormulaError(f"expected {op!r}")

    def binary(self, level: int) -> Column:
        levels = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
        if level == len(levels):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*levels[level]):
            left = self.apply(op, left, self.binary(level + 1))
        return left

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        truth = lambda c: c.cast("double")
        return {
            "||": lambda: truth((a != 0) | (b != 0)), "&&": lambda: truth((a != 0) & (b != 0)), "==": lambda: truth(a == b), "!=": lambda: truth(a != b), "<": lambda: truth(a < b), "<=": lambda: truth(a <= b),
            ">": lambda: truth(a > b), ">=": lambda: truth(a >= b), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, a % F.nullif(b, F.lit(0.0))),
        }[op]()

    def unary(self) -> Column:
        if self.take("-"):
            return -self.unary()
        if self.take("!"):
            return (self.unary() == 0).cast("double")
        base = self.primary()
        if self.take("^"):
            return FUNCTIONS["pow"][2](base, self.unary())
        return base

    def reference(self) -> str:
        """The name in tag('name'), tag("name") or tag(name), after the word tag."""
        self.need("(")
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in ("attr", "word", "num"):
            raise FormulaError("tag() takes a name")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        self.need(")")
        return name

    def primary(self) -> Column:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "word" and word == "tag":
            return self.attribute(self.reference()).cast("double")
        if kind == "num":
            return F.lit(float(word))
        if kind == "attr":
            return self.attribute(word).cast("double")
        if kind == "word":
            if word.lower() not in FUNCTIONS:
                raise FormulaError(f"unknown function {word!r}")
            least, most, f = FUNCTIONS[word.lower()]
            self.need("(")
            args = [self.binary(0)]
            while self.take(","):
                args.append(self.binary(0))
            self.need(")")
            if not least <= len(args) <= most:
                raise FormulaError(f"{word} takes {least} to {most} arguments")
            return f(*args)
        if word == "(":
            inner = self.binary(0)
            self.need(")")
            return inner
        raise FormulaError(f"unexpected {word!r}")


class _RuleParser(_Parser):
    """Trigger rules: x / 0 is 0, numbers within 1e-9 are equal, and a number above a half is true."""

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        near, true = F.abs(a - b) < 1e-9, lambda c: c > 0.5
        own = {
            "/": lambda: F.when(b == 0, a * 0.0).otherwise(F.try_divide(a, b)), "==": lambda: near.cast("double"), "!=": lambda: (~near).cast("double"),
            "&&": lambda: (true(a) & true(b)).cast("double"), "||": lambda: (true(a) | true(b)).cast("double")}
        return own[op]() if op in own else _Parser.apply(op, a, b)


def references(text: str) -> list[str]:
    """The names of attributes and tags in a formula, each once, in order."""
    names: dict[str, None] = {}

    def seen(name: str) -> Column:
        names.setdefault(name)
        return F.lit(0.0)

    compile_formula(text, seen)
    return list(names)


def compile_formula(text: str, attribute: Callable[[str], Column] = F.col, rule: bool = False) -> Column:
    """The column of a formula, or of a trigger rule; attributes are looked up by name."""
    p = (_RuleParser if rule else _Parser)(text, attribute)
    out = p.binary(0)
    if p.at < len(p.tokens):
        raise FormulaError(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def validate(text: str) -> str | None:
    """None for a formula that parses, else what is wrong."""
    try:
        compile_formula(text)
    except FormulaError as e:
        return str(e)
    return None
