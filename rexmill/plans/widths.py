"""Least and greatest number of code points that a node takes."""

from __future__ import annotations

from . import nodes as N


def width(n: N.Node, compiled: N.Compiled, stack: tuple[int, ...] = ()) -> tuple[float, float]:
    if isinstance(n, N.Str):
        return (len(n.cps), len(n.cps)) if n.ic != 1 else (-(-len(n.cps) // 3), 3 * len(n.cps)) if any(c > 127 for c in n.cps) or _folds(n.cps) else (len(n.cps), len(n.cps))
    if isinstance(n, N.Set):
        return (1, 3) if n.ic == 1 and any(c > 127 for c in n.members) else (1, 1)
    if isinstance(n, N.Any):
        return (1, N.INF) if n.segment else (1, 1)
    if isinstance(n, N.Segment):
        return 1, N.INF
    if isinstance(n, N.Newline):
        return 1, 2
    if isinstance(n, N.Cat):
        w = [width(x, compiled, stack) for x in n.items]
        return sum(a for a, _ in w), sum(b for _, b in w)
    if isinstance(n, N.Alt):
        w = [width(x, compiled, stack) for x in n.items]
        return min(a for a, _ in w), max(b for _, b in w)
    if isinstance(n, (N.Group, N.Atomic)):
        return width(n.body, compiled, stack)
    if isinstance(n, N.Rep):
        a, b = width(n.body, compiled, stack)
        return a * n.lo, 0 if not b or not n.hi else b * n.hi
    if isinstance(n, N.Back):
        return 0, N.INF
    if isinstance(n, N.Call):
        return (0, N.INF) if n.target in stack else width(compiled.bodies[n.target], compiled, (*stack, n.target))
    if isinstance(n, N.Cond):
        y = width(n.yes, compiled, stack)
        if n.test is True:
            return y
        # without an else branch a failed test of a group fails, any other matches empty
        o = width(n.no, compiled, stack) if n.no is not None else y if n.groups else (0, 0)
        extra = width(n.test, compiled, stack) if isinstance(n.test, N.Node) and not isinstance(n.test, N.Look) else (0, 0)
        return min(y[0] + extra[0], o[0]), max(y[1] + extra[1], o[1])
    if isinstance(n, N.Absent):
        return (0, N.INF) if n.kind == "function" else width(n.body, compiled, stack) if n.kind == "expression" else (0, 0)
    return 0, 0


def _folds(cps: tuple[int, ...]) -> bool:
    from .charset import expansions

    text = "".join(map(chr, cps)).casefold()
    return any(e in text for e in expansions())
