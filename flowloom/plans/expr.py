"""The filter language: text to tokens, to a tree, to a Column.

    (srcip == 10.0.0.5 || dstport == 443) && dstip == 192.168.0.0/23

&&, || and ^^ have no precedence and fold strictly from the left; parentheses group. Core: names, ==, &&, ||, parentheses.
Extensions: ! and ^^, != > < >= <=, contains, in { , }, slices name[i:j] and name[i:j:k] as in Python, IPv6 addresses and
networks, tag.<id>. Networks include both ends. Unknown names, misplaced tokens and unbalanced brackets raise FilterError.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.decode import cidr


class FilterError(ValueError):
    """The expression isn't part of the language."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


_SYMBOL = re.compile(r"==|!=|>=|<=|&&|\|\||\^\^|[!<>(){}\[\],:]")
_WORD = re.compile(r"[^\s(){}\[\],!<>=|&^]+")
_V4 = re.compile(r"\d+\.\d+\.\d+\.\d+(/\d+)?")
_MAC = re.compile(r"([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")


def classify(word: str) -> str:
    """The kind of a literal or name."""
    if word in ("true", "false"):
        return "bool"
    if word in ("in", "contains"):
        return "op"
    if re.fullmatch(r"\d+|0[xX][0-9A-Fa-f]+", word):
        return "number"
    if re.fullmatch(r"\d+\.\d+", word):
        return "number"
    if _MAC.fullmatch(word):
        return "mac"
    if _V4.fullmatch(word) or word.count(":") >= 2:
        try:
            cidr(word)
        except ValueError as bad:
            raise FilterError(f"no address: {word}") from bad
        return "net" if "/" in word else "ip"
    if re.fullmatch(r"[A-Za-z_]\w*(\.\w+)*", word):
        return "name"
    raise FilterError(f"not understood: {word}")


def tokens(text: str) -> list[Token]:
    out, at, square = [], 0, 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c == '"':
            end = text.find('"', at + 1)
            if end < 0:
                raise FilterError("a string has no end")
            out.append(Token("string", text[at + 1 : end], at))
            at = end + 1
        elif square and (m := re.compile(r"-?\d+").match(text, at)):
            out.append(Token("number", m[0], at))
            at = m.end()
        elif (c != ":" or square) and (m := _SYMBOL.match(text, at)):
            square += (m[0] == "[") - (m[0] == "]")
            out.append(Token("symbol", m[0], at))
            at = m.end()
        elif m := _WORD.match(text, at):
            out.append(Token(classify(m[0]), m[0], at))
            at = m.end()
        else:
            raise FilterError(f"not understood at {at}: {text[at:]}")
    return out


@dataclass(frozen=True)
class Name:
    text: str
    slice: tuple[int | None, int | None, int | None] | None = None


@dataclass(frozen=True)
class Compare:
    left: Name
    op: str
    values: tuple[Token, ...]


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Join:
    op: str
    left: object
    right: object


_JOINS, _COMPARES = ("&&", "||", "^^"), ("==", "!=", ">", "<", ">=", "<=", "contains")
_VALUES = ("number", "ip", "net", "mac", "string", "bool")


class _Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.all[self.at].text if self.at < len(self.all) and self.all[self.at].kind in ("symbol", "op") else None

    def take(self, *want: str) -> Token:
        if self.at == len(self.all):
            raise FilterError("the expression ends too early")
        t = self.all[self.at]
        if (t.text if t.kind in ("symbol", "op") else t.kind) not in want:
            raise FilterError(f"{t.text!r} at {t.at}, where one of {', '.join(want)} should be")
        self.at += 1
        return t

    def whole(self):
        tree = self.chain()
        if self.at < len(self.all):
            raise FilterError(f"{self.all[self.at].text!r} at {self.all[self.at].at} is one too many")
        return tree

    def chain(self):
        tree = self.term()
        while self.peek() in _JOINS:
            op = self.take(*_JOINS).text
            tree = Join(op, tree, self.term())
        return tree

    def term(self):
        if self.peek() == "!":
            self.take("!")
            return Not(self.term())
        if self.peek() == "(":
            self.take("(")
            tree = self.chain()
            self.take(")")
            return tree
        name = Name(self.take("name").text, self.slice())
        if self.peek() == "in":
            self.take("in")
            self.take("{")
            values = [self.take(*_VALUES)]
            while self.peek() == ",":
                self.take(",")
                values.append(self.take(*_VALUES))
            self.take("}")
            return Compare(name, "in", tuple(values))
        return Compare(name, self.take(*_COMPARES).text, (self.take(*_VALUES),))

    def slice(self):
        if self.peek() != "[":
            return None
        self.take("[")
        parts: list[int | None] = [None]
        while self.peek() != "]":
            if self.peek() == ":":
                self.take(":")
                parts.append(None)
            else:
                if parts[-1] is not None:
                    raise FilterError("a slice lacks its colon")
                parts[-1] = int(self.take("number").text)
        self.take("]")
        if not 2 <= len(parts) <= 3 or len(parts) == 3 and not (parts[2] or 0) > 0 or any((x or 0) < 0 for x in parts[:2]):
            raise FilterError("a slice is [i:j] or [i:j:k] with k over 0")
        return (*parts, *[None] * (3 - len(parts)))


def parse(text: str):
    """The tree of an expression."""
    return _Parser(text).whole()


def is_core(tree) -> bool:
    """Whether a tree only uses ==, &&, || and the four flow names."""
    if isinstance(tree, Join):
        return tree.op != "^^" and is_core(tree.left) and is_core(tree.right)
    return isinstance(tree, Compare) and tree.op == "==" and tree.left.slice is None and tree.left.text in ("srcip", "dstip", "srcport", "dstport")


#: Names of the language and the columns that they read: of version 4 and 6 for addresses.
NAMES = {"srcip": ("src_ip", "src_ip6"), "dstip": ("dst_ip", "dst_ip6"), "srcport": ("src_port",), "dstport": ("dst_port",), "caplen": ("caplen",), "flags": ("tcp_flags",), "proto": ("protocol",), "payload": ("payload",), "type": ("event_type",)}


class Compiler:
    """Trees to Columns over a table that has the columns given; tags maps ids to columns."""

    def __init__(self, columns: list[str], names: dict[str, tuple[str, ...]] = NAMES):
        self.columns, self.names = set(columns), names

    def column(self, tree) -> Column:
        if isinstance(tree, Not):
            return ~self.column(tree.of)
        if isinstance(tree, Join):
            a, b = self.column(tree.left), self.column(tree.right)
            return a & b if tree.op == "&&" else a | b if tree.op == "||" else (a | b) & ~(a & b)
        if tree.op == "in":
            plain = [t for t in tree.values if t.kind != "net"]
            tests = [self.compare(tree.left, "==", t) for t in tree.values if t.kind == "net"]
            if plain:
                of, left = self.sides(tree.left, plain)
                tests.append(left.isin([self.value(t, of) for t in plain]))
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        return self.compare(tree.left, tree.op, tree.values[0])

    def sides(self, name: Name, values: list[Token]) -> tuple[str, Column]:
        """The column's kind and the column, after its slice."""
        if m := re.fullmatch(r"tag\.(\d+)", name.text):
            found = (f"tag_{m[1]}",)
        elif name.text in self.names:
            found = self.names[name.text]
        else:
            raise FilterError(f"unknown name: {name.text}")
        six = {t.kind in ("ip", "net") and ":" in t.text for t in values}
        if len(six) > 1:
            raise FilterError("addresses of both versions in one set")
        if len(found) == 1 and any(t.kind in ("ip", "net", "mac") for t in values):
            raise FilterError(f"{name.text} is no address")
        if len(found) == 2 and not all(t.kind in ("ip", "net") for t in values) and name.slice is None:
            raise FilterError(f"{name.text} needs an address")
        column = found[1] if len(found) == 2 and True in six else found[0]
        if column not in self.columns:
            raise FilterError(f"the table has no {column}")
        kind = "six" if len(found) == 2 and True in six else "four" if len(found) == 2 else "bytes" if column == "payload" else "text" if column == "event_type" else "number"
        c = F.col(column)
        if name.slice:
            i, j, k = name.slice
            if kind not in ("bytes", "text"):
                raise FilterError(f"{name.text} can't be sliced")
            size = F.octet_length(c) if kind == "bytes" else F.length(c)
            end = size if j is None else F.least(F.lit(j), size)
            c = F.substring(c, F.lit((i or 0) + 1), F.greatest(end - (i or 0), F.lit(0)))
            if k and k > 1:
                units = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(c) if kind == "bytes" else F.length(c), F.lit(1)), F.lit(k)), lambda p: F.substring(F.hex(c) if kind == "bytes" else c, 2 * p - 1 if kind == "bytes" else p, F.lit(2 if kind == "bytes" else 1)))
                c = F.unhex(F.array_join(units, "")) if kind == "bytes" else F.array_join(units, "")
        return kind, c

    @staticmethod
    def value(t: Token, kind: str):
        if kind == "four":
            return int(ipaddress.IPv4Address(t.text))
        if kind == "six":
            return ipaddress.IPv6Address(t.text).packed
        if kind == "bytes":
            try:
                return bytes.fromhex(t.text[2:] if t.text.lower().startswith("0x") else t.text)
            except ValueError:
                return t.text.encode()
        if kind == "text":
            return t.text
        if t.kind not in ("number", "bool"):
            raise FilterError(f"{t.text} is no number")
        return int(t.text == "true") if t.kind == "bool" else float(t.text) if "." in t.text else int(t.text, 0)

    def compare(self, name: Name, op: str, t: Token) -> Column:
        kind, c = self.sides(name, [t])
        if t.kind == "net":
            version, lo, hi = cidr(t.text)
            a, b = (lo, hi) if version == 4 else (lo.to_bytes(16, "big"), hi.to_bytes(16, "big"))
            if op not in ("==", "!="):
                raise FilterError(f"{op} with a network")
            inside = c.between(F.lit(a), F.lit(b))
            return inside if op == "==" else ~inside
        v = F.lit(self.value(t, kind))
        if op == "contains":
            if kind not in ("bytes", "text"):
                raise FilterError(f"{name.text} contains nothing")
            return F.contains(c, v)
        return {"==": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def compile_filter(text: str, columns: list[str]) -> Column:
    """The Column of an expression over a table's columns."""
    return Compiler(columns).column(parse(text))
