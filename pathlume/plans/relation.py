"""Boolean relations between conditions: ``$0 and ($named or $2)``.

Grammar, AND binding tighter than OR::

    any    := all (("or" | "||") all)*
    all    := single (("and" | "&&") single)*
    single := "$" index | "$" name | "(" any ")"

Letters count alike in either case; blanks around operators are free.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pathlume.plans.errors import ProblemKind, QueryProblem

TOKEN = re.compile(r"\s*(?:(?P<ref>\$(?:\d+|[a-z][a-z_0-9]*)(?![a-z_0-9]))|(?P<op>&&|\|\||and|or)|(?P<open>\()|(?P<close>\)))")
T = TypeVar("T")


@dataclass(frozen=True)
class Condition:
    index: int


@dataclass(frozen=True)
class Joined:
    operator: str  # "and" or "or"
    parts: tuple


Relation = Condition | Joined


def _wrong(what: str) -> QueryProblem:
    return QueryProblem(ProblemKind.RELATION, f"relation: {what}")


class _Reader:
    def __init__(self, text: str, names: dict[str, int], count: int):
        self.names, self.count, self.at = names, count, 0
        self.tokens: list[tuple[str, str]] = []
        place, text = 0, text.lower().rstrip()
        while place < len(text):
            m = TOKEN.match(text, place)
            if not m:
                raise _wrong(f"cannot be read from {text[place:place + 20]!r} on")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            place = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def joined(self, operator: str, signs: tuple[str, str], part: Callable[[], Relation]) -> Relation:
        parts = [part()]
        while self.peek()[0] == "op" and self.peek()[1] in signs:
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Joined(operator, tuple(parts))

    def any(self) -> Relation:
        return self.joined("or", ("or", "||"), self.all)

    def all(self) -> Relation:
        return self.joined("and", ("and", "&&"), self.single)

    def single(self) -> Relation:
        kind, sign = self.take()
        if kind == "open":
            inner = self.any()
            if self.take()[0] != "close":
                raise _wrong("a parenthesis is not closed")
            return inner
        if kind != "ref":
            raise _wrong(f"expected a condition, found {sign!r}" if sign else "ends where a condition is expected")
        name = sign[1:]
        if name.isdigit():
            if int(name) >= self.count:
                raise _wrong(f"there is no condition {sign}")
            return Condition(int(name))
        if name not in self.names:
            raise _wrong(f"no condition is named {name}")
        return Condition(self.names[name])


def parse_relation(text: str, names: dict[str, int], count: int) -> Relation:
    """``names``: condition number by lower-case name; ``count``: number of conditions."""
    reader = _Reader(text, names, count)
    if not reader.tokens:
        raise _wrong("is empty")
    found = reader.any()
    if reader.at < len(reader.tokens):
        raise _wrong(f"does not go on with {reader.peek()[1]!r}")
    return found


def simple_relation(operator: str, count: int) -> str:
    """All conditions joined by one operator."""
    return f" {operator} ".join(f"${i}" for i in range(count))


def conditions_in(relation: Relation) -> list[int]:
    if isinstance(relation, Condition):
        return [relation.index]
    return list(dict.fromkeys(i for p in relation.parts for i in conditions_in(p)))


def fold(relation: Relation, leaf: Callable[[int], T], both: Callable[[T, T], T], either: Callable[[T, T], T]) -> T:
    if isinstance(relation, Condition):
        return leaf(relation.index)
    return reduce(both if relation.operator == "and" else either, (fold(p, leaf, both, either) for p in relation.parts))
