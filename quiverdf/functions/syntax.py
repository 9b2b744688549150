"""Reader of the expression language: text to a tree of plain tuples.

A node is one of
    ("num", value)  ("str", text)  ("name", dotted)  ("call", dotted, [nodes])  ("index", dotted, node)
    ("un", op, node)  ("bin", op, a, b)  ("if", c, a, b)  ("list", [nodes])  ("range", a, b)
    ("set", name, node)  ("seq", [nodes])  ("label", name, node)
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"\s*(?:(?P<num>0x[0-9A-Fa-f]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<name>\.?[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(?P<op>\*\*|:=|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%!~<>&^|?:=,;()\[\]{}]))"
)

#: Binding powers of infix operators, weakest first; ** and ?: bind to the right.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("in", "notin"), ("**",))
POWER = {op: 10 * (k + 1) for k, level in enumerate(LEVELS) for op in level}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


class ExpressionError(ValueError):
    """The text is not an expression, or names something unknown."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 12]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Reader:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] != "str" else ""

    def take(self, want: str = "") -> tuple[str, str]:
        if self.at >= len(self.items):
            raise ExpressionError(f"expected {want or 'more'} at the end")
        item = self.items[self.at]
        if want and (item[0] == "str" or item[1] != want):
            raise ExpressionError(f"expected {want}, found {item[1]!r}")
        self.at += 1
        return item

    def sequence(self, ends: str = "") -> tuple:
        parts = []
        while self.at < len(self.items) and not (ends and self.peek() == ends):
            parts.append(self.statement())
            if self.peek() in (";", ",") and (self.peek() == ";" or not ends):
                self.take()
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def statement(self) -> tuple:
        if self.at + 1 < len(self.items) and self.items[self.at][0] == "name" and self.items[self.at + 1] in (("op", "="), ("op", ":=")):
            name = self.take()[1]
            return ("define" if self.take()[1] == ":=" else "set", name, self.statement())
        node = self.expression(0)
        if self.peek() == ":" and node[0] in ("name", "str"):
            self.take()
            return ("label", node[1], self.statement())
        return node

    def expression(self, least: int) -> tuple:
        left = self.prefix()
        while True:
            op = self.peek()
            if op == "?" and least <= 5:
                self.take()
                yes = self.expression(5)
                self.take(":")
                left = ("if", left, yes, self.expression(5))
            elif op in POWER and POWER[op] > least:
                self.take()
                right = self.expression(POWER[op] - (op == "**"))
                left = ("bin", op, left, right)
            else:
                return left

    def prefix(self) -> tuple:
        kind, text = self.take()
        if kind == "op":
            if text in "-+!~":
                # Signs bind like ** does, from the right.
                return ("un", text, self.expression(POWER["**"] - 1))
            if text == "(":
                node = self.sequence(")")
                self.take(")")
                return node
            if text == "{":
                return ("list", self.arguments("}"))
            raise ExpressionError(f"unexpected {text!r}")
        if kind == "num":
            return ("num", int(text, 16) if text[:2] == "0x" else int(text) if text.isdigit() else float(text))
        if kind == "str":
            return ("str", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1]))
        if self.peek() == "(":
            self.take()
            args = self.arguments(")")
            return ("range", *args) if text == "range" and len(args) == 2 else ("call", text, args)
        if self.peek() == "[":
            self.take()
            inner = self.sequence("]")
            self.take("]")
            return ("index", text, inner)
        return ("name", text)

    def arguments(self, end: str) -> list[tuple]:
        out = []
        while self.peek() != end:
            out.append(self.statement())
            if self.peek() == ",":
                self.take()
            elif self.peek() != end:
                raise ExpressionError(f"expected , or {end}, found {self.peek()!r}")
        self.take(end)
        return out


def read(text: str) -> tuple:
    """The tree of an expression; several ones divided by ; give ("seq", ...)."""
    r = Reader(text)
    node = r.sequence()
    if r.at < len(r.items):
        raise ExpressionError(f"unexpected {r.items[r.at][1]!r}")
    return node
