"""Which tier runs an operator: ``native`` (Catalyst expressions) or ``kernel`` (Arrow)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from ..operators.api import Regex, regex, template_parts
from . import nodes as N
from .java import Native, NotNative, required_literal, to_java
from .widths import width


@dataclass(frozen=True)
class Plan:
    tier: str
    reason: str
    native: Native | None
    required: str
    min_width: float


@functools.lru_cache(4096)
def marked(pattern: str, flags: str) -> Native | None:
    """Java's form with a group that tells for each capture whether it is set; None if there is none."""
    try:
        return to_java(regex(pattern, flags).compiled, marked=True)
    except NotNative:
        return None


@functools.lru_cache(4096)
def _plan(pattern: str, flags: str) -> Plan:
    c = regex(pattern, flags).compiled
    lo = width(c.root, c)[0]
    try:
        return Plan("native", "", n := to_java(c), n.required, lo)
    except NotNative as e:
        odd = c.longest or any(isinstance(x, (N.Absent, N.Call, N.Cond)) for x in N.walk(c.root))
        return Plan("kernel", str(e), None, "" if odd else required_literal(c.root), lo)


def plan(rx: Regex, op: str, template: str | None = None, count: int = 0, start: int = 0) -> Plan:
    """The tier of ``op`` with its preconditions."""
    p = _plan(rx.pattern, rx.flags)
    if p.native is None:
        return p
    why = ""
    if op in ("find_all", "find_all_spans", "count", "replace", "split") and not p.min_width:
        why = "empty matches"
    elif op in ("replace_with", "captures"):
        why = "a function of the spans"
    elif op in ("spans", "find_all_spans") and rx.capture_count:
        why = "spans of groups"
    elif start:
        why = "a start position"
    elif op == "backward" and any(isinstance(x, N.Look) and x.behind for x in N.walk(rx.compiled.root)):
        why = "lookbehind in a backward search"
    elif p.native.keep[1] and op not in ("matches", "find", "find_all", "count"):
        why = r"\K where the match's start counts"
    elif p.native.loose and rx.capture_count and op in ("extract", "replace", "split"):
        why = "groups that calls set"
    elif p.native.chained and op in ("backward", "spans", "span", "split", "extract", "find_all_spans"):
        why = r"\G inside another pattern"
    return Plan("kernel", why, None, p.required, p.min_width) if why else p


def java_template(rx: Regex, native: Native, template: str) -> str:
    """A replacement template in Java's syntax; a digit after a group number is escaped."""
    out = []
    parts = template_parts(rx, template)
    for i, part in enumerate(parts):
        if isinstance(part, str):
            out.append(part.replace("\\", "\\\\").replace("$", "\\$"))
            continue
        out.append(f"${native.groups[part - 1] if part else 0}")
        if i + 1 < len(parts) and isinstance(parts[i + 1], str) and parts[i + 1][0].isdigit():
            out.append("\\")
    return "".join(out)
