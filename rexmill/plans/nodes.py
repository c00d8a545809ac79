"""Pattern trees. Flags are resolved while parsing, so nodes carry what they need."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any as Anything

from .charset import CharSet

INF = float("inf")


class Node:
    pass


@dataclass
class Empty(Node):
    pass


@dataclass
class Fail(Node):
    pass


@dataclass
class Str(Node):
    """Literal code points; ic: 0 exact, 1 any case, 2 any ASCII case."""

    cps: tuple[int, ...]
    ic: int = 0


@dataclass
class Set(Node):
    set: CharSet
    ic: int = 0
    members: tuple[int, ...] = ()  # literal members, for foldings of several characters


@dataclass
class Any(Node):
    dotall: bool
    segment: str = ""  # "g" or "w": a whole grapheme or word


@dataclass
class Segment(Node):
    """\\X"""

    kind: str = "g"


@dataclass
class Newline(Node):
    """\\R"""


@dataclass
class Anchor(Node):
    kind: str  # ^ $ A z Z G b B y Y
    word: CharSet | None = None
    segment: str = "g"


@dataclass
class Keep(Node):
    pass


@dataclass
class Cat(Node):
    items: list[Node]


@dataclass
class Alt(Node):
    items: list[Node]


@dataclass
class Group(Node):
    index: int
    body: Node
    name: str | None = None


@dataclass
class Rep(Node):
    body: Node
    lo: int
    hi: float
    kind: str  # greedy lazy possessive


@dataclass
class Look(Node):
    body: Node
    behind: bool
    negative: bool


@dataclass
class Atomic(Node):
    body: Node


@dataclass
class Back(Node):
    ref: Anything  # index, relative ("+"/"-", n) or name; groups after resolution
    ic: int = 0
    level: int | None = None
    groups: tuple[int, ...] = ()


@dataclass
class Call(Node):
    ref: Anything
    target: int = -1


@dataclass
class Cond(Node):
    test: Anything  # True, False, a Node, or a reference like Back.ref
    yes: Node
    no: Node | None
    groups: tuple[int, ...] = ()


@dataclass
class Absent(Node):
    kind: str  # function, expression, range, clear
    what: Node | None = None
    body: Node | None = None


@dataclass
class Callout(Node):
    kind: str  # MAX COUNT CMP
    tag: str = ""
    args: tuple = ()


@dataclass
class Compiled:
    pattern: str
    root: Node
    flags: str
    capture_count: int
    named: list[tuple[str, int]]
    longest: bool = False
    bodies: dict[int, Node] = field(default_factory=dict)


def children(n: Node) -> list[Node]:
    if isinstance(n, (Cat, Alt)):
        return list(n.items)
    if isinstance(n, (Group, Rep, Look, Atomic)):
        return [n.body]
    if isinstance(n, Cond):
        return [x for x in (n.test if isinstance(n.test, Node) else None, n.yes, n.no) if x is not None]
    if isinstance(n, Absent):
        return [x for x in (n.what, n.body) if x is not None]
    return []


def walk(n: Node):
    yield n
    for c in children(n):
        yield from walk(c)
