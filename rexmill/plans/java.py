"""Patterns to Java's syntax, where that is exact and safe; facts for prefilters."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import charset as C
from . import nodes as N
from .widths import width


class NotNative(Exception):
    """Why a pattern must run in the kernel."""


@dataclass(frozen=True)
class Native:
    pattern: str
    groups: tuple[int, ...]  # Java group number of each capture
    literal: str | None  # the whole pattern, if it is a plain literal
    anchored: bool = False
    required: str = ""  # a literal that every match contains
    keep: tuple[int, int] = (0, 0)  # groups of what is before and after \K
    loose: bool = False  # calls were written out, so groups don't hold what they should
    chained: bool = False  # \G: only for searches that go on from match to match
    marks: tuple[int, ...] = ()  # group that is set with each capture, 0: none
    notes: tuple[str, ...] = field(default=())


def _class(body: str) -> str:
    return body if body.startswith("[") and body.endswith("]") and body.count("[") == 1 else f"[{body}]"


def _set(s: C.CharSet) -> str:
    if s.body is None:
        raise NotNative("a set that Java lacks")
    return _class(s.body)


def _long(n: N.Set) -> list[str]:
    """Foldings of several characters that a caseless set matches."""
    return [e for m in n.members if (e := C.expansion(m))] if n.ic == 1 else []


def _plain(n: N.Set) -> C.CharSet:
    """The set with all cases written out: Java's own tables are older."""
    return C.closure(n.set, n.ic) if n.ic else n.set


def _folded(want: str) -> str:
    """Every text whose folding is ``want``. A character folds in one way, so the branches exclude each other."""
    one = lambda c: _class("".join(map(C.esc, cps))) if len(cps := C.folding_to(c)) > 1 else "".join(map(C.esc, cps)) or C.esc(ord(c))
    long = [(i, e, cps) for i in range(len(want)) for e, cps in C.expansions().items() if want.startswith(e, i)]

    def branches(i: int, end: int) -> str:
        if i >= end:
            return ""
        arms = [one(want[i]) + branches(i + 1, end)]
        arms += [_class("".join(map(C.esc, cps))) + branches(i + len(e), end) for at, e, cps in long if at == i]
        return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"

    out, i = [], 0
    while i < len(want):
        end = i + 1
        for at, e, _ in long:  # in order of position
            if i <= at < end:
                end = max(end, at + len(e))
        if end - i > 8:
            raise NotNative("a long chain of foldings")
        out.append(branches(i, end))
        i = end
    return "".join(out)


def _nullable(n: N.Node, c: N.Compiled) -> bool:
    return width(n, c)[0] == 0


def _has(n: N.Node, kind) -> bool:
    return any(isinstance(x, kind) for x in N.walk(n))


def _first(n: N.Node) -> list[C.CharSet] | None:
    """Sets of the characters that can begin n, if any; None if unknown."""
    if isinstance(n, N.Empty):
        return []
    if isinstance(n, N.Anchor) and n.kind in "$Zz":  # no character, or a newline
        return [C.NOTHING if n.kind == "z" else C.NEWLINE]
    if isinstance(n, N.Str):
        if n.ic == 1:
            want = "".join(map(chr, n.cps)).casefold()
            return [C.listed([*C.folding_to(want[0]), *(c for e, cps in C.expansions().items() if want.startswith(e) for c in cps)])]
        return [C.closure(C.span(n.cps[0], n.cps[0]), n.ic) if n.ic else C.span(n.cps[0], n.cps[0])]
    if isinstance(n, (N.Set, N.Any)):
        one = _single(n)
        return None if one is None else [one]
    if isinstance(n, (N.Group, N.Atomic, N.Rep)):
        return _first(n.body)
    if isinstance(n, N.Cat):
        return _first_of(n.items)
    if isinstance(n, N.Alt):
        got = [_first(x) for x in n.items]
        return None if any(g is None for g in got) else [s for g in got for s in g]
    return None


def _skips(n: N.Node) -> bool:
    """Can n match nothing, whatever comes?"""
    if isinstance(n, (N.Group, N.Atomic)):
        return _skips(n.body)
    if isinstance(n, N.Cat):
        return all(map(_skips, n.items))
    if isinstance(n, N.Alt):
        return any(map(_skips, n.items))
    return isinstance(n, N.Empty) or (isinstance(n, N.Rep) and n.lo == 0)


def _first_of(items: list[N.Node]) -> list[C.CharSet] | None:
    """Sets of the characters that can begin a sequence that isn't empty."""
    out: list[C.CharSet] = []
    for x in items:
        got = _first(x)
        if got is None:
            return None
        out += got
        if not _skips(x):
            break
    return out


def _disjoint(a: list[C.CharSet] | None, b: list[C.CharSet] | None) -> bool:
    return a is not None and b is not None and all(C.apart(s, t) for s in a for t in b)


def _single(n: N.Node) -> C.CharSet | None:
    """The set of a node that always takes one character."""
    if isinstance(n, N.Cat) and len(n.items) == 1:
        return _single(n.items[0])
    if isinstance(n, N.Str) and len(n.cps) == 1:
        if n.ic == 1 and C.expansion(n.cps[0]):
            return None
        return C.closure(C.span(n.cps[0], n.cps[0]), n.ic) if n.ic else C.span(n.cps[0], n.cps[0])
    if isinstance(n, N.Set):
        return None if _long(n) else _plain(n)
    if isinstance(n, N.Any) and not n.segment:
        return C.ANY if n.dotall else C.NEWLINE.negate()
    if isinstance(n, N.Alt):
        got = [_single(x) for x in n.items]
        return None if any(g is None for g in got) else C.union(*got)
    return None


def _one_way(n: N.Node, after: list[C.CharSet] | None) -> N.Node | None:
    """n with its loops possessive, if it can match in one way only where one of ``after`` follows (None: unknown); else None.

    So it is if its branches begin apart from each other, and its loops run over
    single characters, apart from what follows them.
    """
    if isinstance(n, N.Group):
        body = _one_way(n.body, after)
        return None if body is None else N.Group(n.index, body, n.name)
    if isinstance(n, N.Alt):
        arms = [_one_way(x, after) for x in n.items]
        heads = [_first(x) for x in n.items]
        if any(a is None for a in arms) or any(map(_skips, n.items)) or not all(_disjoint(x, y) for i, x in enumerate(heads) for y in heads[:i]):
            return None
        return N.Alt(arms)
    if isinstance(n, N.Cat):
        out: list[N.Node] = []
        for i, x in enumerate(n.items):
            rest = n.items[i + 1 :]
            follow = _first_of(rest)
            if all(map(_skips, rest)):
                follow = None if follow is None or after is None else follow + after
            got = _one_way(x, follow)
            if got is None:
                return None
            out.append(got)
        return N.Cat(out)
    if isinstance(n, N.Rep):
        one = _single(n.body)
        if n.lo == n.hi and one is not None:
            return n
        if one is None or n.kind == "lazy" or not (n.kind == "possessive" or _disjoint([one], after)):
            return None
        return N.Rep(n.body, n.lo, n.hi, "possessive")
    if isinstance(n, N.Str) or _single(n) is not None or isinstance(n, N.Empty):
        return n
    return None


def _settled(loop: N.Node, rest: list[N.Node]) -> N.Node | None:
    """The loop as a possessive one, if it can run up to what follows in one way only; else None."""
    if not (isinstance(loop, N.Rep) and loop.kind == "greedy" and loop.hi == N.INF) or _single(loop.body) is not None:
        return None
    follow, heads = _first_of(rest), _first(loop.body)
    if follow is None or not follow or all(map(_skips, rest)) or not _disjoint(heads, follow) or _skips(loop.body):
        return None
    body = _one_way(loop.body, heads + follow)
    return None if body is None else N.Rep(body, loop.lo, loop.hi, "possessive")


def _last(n: N.Node) -> N.Node:
    """n with the greedy loop at its end possessive: nothing follows that could make it give back."""
    if isinstance(n, N.Cat) and n.items:
        return N.Cat([*n.items[:-1], _last(n.items[-1])])
    if isinstance(n, N.Alt):
        return N.Alt([_last(x) for x in n.items])
    if isinstance(n, N.Group):
        return N.Group(n.index, _last(n.body), n.name)
    if isinstance(n, N.Rep) and n.kind == "greedy" and n.hi == N.INF and _single(n.body) is None:
        return N.Rep(n.body, n.lo, n.hi, "possessive")
    return n


def _bounded(n: N.Rep, root: N.Node) -> N.Rep | None:
    """A loop whose body counts its rounds by a callout of its own, with the callout's limit as its bound."""
    body = n.body
    while isinstance(body, N.Cat) and len(body.items) == 1:
        body = body.items[0]
    items = body.items if isinstance(body, N.Cat) else [body]
    mine = [x for x in items if isinstance(x, N.Callout)]
    has = lambda x: sum(isinstance(y, N.Callout) for y in N.walk(x))
    if len(mine) != 1 or has(root) != 1 or sum(isinstance(r, N.Rep) and has(r) for r in N.walk(root)) != 1:
        return None
    if mine[0].kind != "MAX" or n.lo > mine[0].args[0] or any(isinstance(x, (N.Call, N.Look, N.Absent)) for x in N.walk(root)):
        return None
    left = [x for x in items if x is not mine[0]]
    return N.Rep(N.Cat(left), n.lo, min(n.hi, mine[0].args[0]), n.kind)


class Emitter:
    def __init__(self, compiled: N.Compiled, marked: bool = False):
        self.c, self.count, self.number = compiled, 0, {}
        self.tested = {g for n in N.walk(compiled.root) if isinstance(n, N.Cond) for g in n.groups}
        if marked:
            self.tested |= set(range(1, compiled.capture_count + 1))
        self.marks: dict[int, int] = {}
        self.calls: list[int] = []
        self.loose = self.chained = False

    def emit(self, n: N.Node) -> str:
        return getattr(self, "_" + type(n).__name__.lower())(n)

    def wrap(self, n: N.Node) -> str:
        return f"(?:{self.emit(n)})"

    def _empty(self, n):
        return ""

    def _fail(self, n):
        return "(?!)"

    def _str(self, n):
        text = "".join(C.esc(x) for x in n.cps)
        if not n.ic or not any(len(C.variants(x)) > 1 for x in n.cps):
            return text
        if n.ic == 1:
            return _folded("".join(map(chr, n.cps)).casefold())
        return f"(?i:{text})"

    def _set(self, n):
        own = _set(_plain(n))
        return f"(?:{'|'.join([own, *map(_folded, _long(n))])})" if _long(n) else own

    def _any(self, n):
        if n.segment:
            raise NotNative("text segments")
        return r"[\s\S]" if n.dotall else r"[^\n]"

    def _segment(self, n):
        raise NotNative("text segments")

    def _newline(self, n):
        return r"(?>\r\n|[\n-\r\x{85}\x{2028}\x{2029}])"

    def _anchor(self, n):
        if n.kind in "bB":
            w = _class(n.word.body)
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))" if n.kind == "b" else f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
        got = {"^": r"(?<![^\n])", "$": r"(?![^\n])", "A": r"\A", "z": r"\z", "Z": r"(?=\n?\z)", "G": r"\G"}.get(n.kind)
        self.chained |= n.kind == "G"
        if got is None:
            raise NotNative(f"\\{n.kind}")
        return got

    def _keep(self, n):
        raise NotNative(r"\K")

    def _cat(self, n):
        items = [_settled(x, n.items[i + 1 :]) or x for i, x in enumerate(n.items)]
        return "".join(self.wrap(x) if isinstance(x, N.Alt) else self.emit(x) for x in items)

    def _alt(self, n):
        return "|".join(self.emit(x) for x in n.items)

    def _group(self, n):
        if self.calls:
            return self.wrap(n.body)
        self.count += 1
        self.number[n.index] = self.count
        out = f"({self.emit(n.body)})"
        if n.index in self.tested:
            self.count += 1
            self.marks[n.index] = self.count
            out = f"(?:{out}())"
        return out

    def _rep(self, n):
        n = _bounded(n, self.c.root) or n
        suffix = {"greedy": "", "lazy": "?", "possessive": "+"}[n.kind]
        if n.hi == N.INF:
            count = {0: "*", 1: "+"}.get(n.lo, f"{{{n.lo},}}")
        else:
            count = "?" if (n.lo, n.hi) == (0, 1) else f"{{{n.lo}}}" if n.lo == n.hi else f"{{{n.lo},{int(n.hi)}}}"
        one = _single(n.body)
        if one is not None:
            return _set(one) + count + suffix
        if _nullable(n.body, self.c) and (_has(n.body, N.Group) or n.hi > 1):
            raise NotNative("a body that can be empty is repeated")
        if n.hi > 1:
            self.safe(n)
        body = n.body.items[0] if isinstance(n.body, N.Cat) and len(n.body.items) == 1 else n.body
        return (self.emit(body) if isinstance(body, N.Group) and body.index not in self.tested else f"(?:{self.emit(body)})") + count + suffix

    def safe(self, n: N.Rep):
        """Long loops over groups recurse in Java and can overflow its stack; ambiguous ones take exponential time."""
        if n.hi > 256 and n.kind != "possessive":
            raise NotNative("an unbounded loop over a group")
        if any(isinstance(x, N.Rep) and x.hi > 1 and x is not n for x in N.walk(n.body)) and not (n.hi <= 8 or n.kind == "possessive"):
            raise NotNative("nested loops")

    def _look(self, n):
        if n.behind and width(n.body, self.c)[1] > 255:
            raise NotNative("unbounded lookbehind")
        if n.behind and isinstance(n.body, N.Alt) and any(_has(x, N.Group) for x in n.body.items):
            raise NotNative("captures in alternatives of a lookbehind")
        return f"(?{'<' if n.behind else ''}{'!' if n.negative else '='}{self.emit(n.body)})"

    def _atomic(self, n):
        return f"(?>{self.emit(n.body)})"

    def _back(self, n):
        if n.level is not None or n.ic == 1 or any(g not in self.number for g in n.groups):
            raise NotNative("a reference that Java lacks")
        arms = [f"\\{self.number[g]}(?:)" for g in n.groups]
        text = arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"
        return f"(?i:{text})" if n.ic else text

    def _call(self, n):
        """A group that isn't called from within is written out where it is called."""
        body = self.c.bodies[n.target]
        if n.target == 0 or n.target in self.calls:
            raise NotNative("recursive calls of groups")
        inside = {x.index for x in N.walk(body) if isinstance(x, N.Group)}
        if any(isinstance(x, (N.Back, N.Cond)) and inside & set(x.groups) for x in N.walk(self.c.root)):
            raise NotNative("calls of groups that are referred to")
        self.loose = True
        self.calls.append(n.target)
        out = self.wrap(body)
        self.calls.pop()
        return out

    def _cond(self, n):
        yes, no = self.wrap(n.yes), self.wrap(n.no) if n.no is not None else None
        if n.test is True:
            return yes
        if n.test is False:
            return no or ""
        if isinstance(n.test, N.Look):
            if _has(n.test, N.Group):
                raise NotNative("captures in a condition")
            test, other = self.emit(n.test), self.emit(N.Look(n.test.body, n.test.behind, not n.test.negative))
            return f"(?:{test}{yes}|{other}{no or ''})"
        if isinstance(n.test, N.Node):
            if _has(n.test, N.Group):
                raise NotNative("captures in a condition")
            body = self.emit(n.test)
            return f"(?:(?>{body}){yes}|(?!{body}){no or ''})"
        if any(g not in self.marks for g in n.groups):
            raise NotNative("a condition on a later group")
        marks = [f"\\{self.marks[g]}(?:)" for g in n.groups]
        test = marks[0] if len(marks) == 1 else f"(?:{'|'.join(marks)})"
        return f"(?:{test}{yes}|(?!{test}){no if no is not None else '(?!)'})"

    def _absent(self, n):
        if n.kind == "function" and not _nullable(n.what, self.c) and not _has(n.what, (N.Group, N.Look, N.Anchor)):
            return rf"(?:(?!{self.emit(n.what)})[\s\S])*"
        if n.kind == "clear" and not any(isinstance(x, N.Absent) and x.kind == "range" for x in N.walk(self.c.root)):
            return ""
        raise NotNative("absent operators")

    def _callout(self, n):
        raise NotNative("callouts")


#: Characters on which loops are compared where only speed depends on it.
_PROBE = [*range(0x250), *range(0x370, 0x500), 0x660, 0x2028, 0x2029, 0x3000, 0x3042, 0x4E00, 0xAC00, 0x1F600, 0x300, 0x20AC]


def _ambiguous(n: N.Node) -> bool:
    """Two unbounded loops in a sequence that can trade characters, twice or more: not linear."""
    if isinstance(n, N.Cat):
        loops = 0
        for a, b in zip(n.items, n.items[1:]):
            for x in (a,):
                if isinstance(x, N.Rep) and x.hi == N.INF and x.kind != "possessive":
                    s, t = _single(x.body), _first(b)
                    if s is None or t is None or any(s.test(c) and y.test(c) for y in t for c in _PROBE):
                        loops += 1
        if loops > 3:
            return True
    return any(_ambiguous(c) for c in N.children(n))


def required_literal(n: N.Node) -> str:
    """The longest literal that every match contains."""
    if isinstance(n, N.Str):
        return "" if n.ic else "".join(map(chr, n.cps))
    if isinstance(n, (N.Group, N.Atomic)):
        return required_literal(n.body)
    if isinstance(n, N.Rep):
        return required_literal(n.body) if n.lo > 0 and n.hi >= n.lo else ""
    if isinstance(n, N.Cat):
        return max((required_literal(x) for x in n.items), key=len, default="")
    return ""


def to_java(compiled: N.Compiled, marked: bool = False) -> Native:
    """Java's form of a pattern; ``marked``: with a group that is set with each capture."""
    if compiled.longest:
        raise NotNative("longest match")
    root = _last(compiled.root)
    if _ambiguous(root):
        raise NotNative("neighbouring loops over the same characters")
    e, keep = Emitter(compiled, marked), (0, 0)
    kept = [i for i, x in enumerate(root.items) if isinstance(x, N.Keep)] if isinstance(root, N.Cat) else []
    if len(kept) == 1:
        # what is before and after \K as groups
        parts = []
        for items in (root.items[: kept[0]], root.items[kept[0] + 1 :]):
            e.count += 1
            number = e.count
            parts.append((number, f"({e.emit(N.Cat(items))})"))
        keep, text = (parts[0][0], parts[1][0]), parts[0][1] + parts[1][1]
    else:
        text = e.emit(root)
    groups = tuple(e.number.get(i, 0) for i in range(1, compiled.capture_count + 1))
    if 0 in groups:
        raise NotNative("a group is left out")
    literal = "".join(map(chr, root.cps)) if isinstance(root, N.Str) and not root.ic else None
    first = root.items[0] if isinstance(root, N.Cat) and root.items else root
    marks = tuple(e.marks.get(i, 0) for i in range(1, compiled.capture_count + 1))
    return Native(text, groups, literal, isinstance(first, N.Anchor) and first.kind == "A", required_literal(root), keep, e.loose, e.chained, marks)
