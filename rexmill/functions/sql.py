"""SQL functions with the pattern as an argument, and the table function of matches.

``register`` makes the ``rx_*`` functions known. They take any pattern, a column
too, and run in the kernel. ``sql`` runs a query in which those calls whose
pattern and options are literals are written as built-in functions where the
planner allows it, so they stay in the JVM and their filters reach the scan.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as kind_of

from ..operators import api
from ..plans.planner import java_template, marked, plan
from .columns import MATCH, _shifted, _surely, _to_match, bound_batches


def _group(rx: api.Regex, g) -> int:
    """1-based number of a group given by number or name; -1 if there is none."""
    i = rx.capture_index(g) if isinstance(g, str) and not g.isdecimal() else int(g)
    return i if 0 <= i <= rx.capture_count else -1


def _text(t, m, i=0):
    return api.span_text(t, m[i]) if m and i >= 0 else None


#: name: result type, defaults of the arguments after text and pattern (flags among them), function of (regex, text, *arguments)
FUNCTIONS = {
    "rx_matches": ("boolean", {"flags": ""}, lambda rx, t: api.search(rx, t) is not None),
    "rx_find": ("string", {"flags": "", "start": 0}, lambda rx, t, start: _text(t, api.search(rx, t, int(start)))),
    "rx_extract": ("string", {"group": 0, "flags": ""}, lambda rx, t, g: _text(t, api.search(rx, t), _group(rx, g))),
    "rx_find_all_text": ("array<string>", {"group": 0, "flags": ""}, lambda rx, t, g: api.find_all_text(rx, t, max(_group(rx, g), 0))),
    "rx_count": ("int", {"flags": ""}, lambda rx, t: sum(1 for _ in api.find_all(rx, t))),
    "rx_replace": ("string", {"template": "", "count": 0, "flags": ""}, lambda rx, t, template, n: api.replace(rx, t, template, int(n))),
    "rx_split": ("array<string>", {"max_split": 0, "flags": ""}, lambda rx, t, n: api.split(rx, t, int(n))),
    "rx_find_backward": ("string", {"flags": "", "start": -1}, lambda rx, t, start: _text(t, api.search_backward(rx, t, int(start)))),
    "rx_search": (MATCH, {"flags": "", "start": 0}, lambda rx, t, start: _to_match(api.search(rx, t, int(start)))),
    "rx_match_at": (MATCH, {"pos": 0, "flags": ""}, lambda rx, t, pos: _to_match(api.match_at(rx, t, int(pos)))),
    "rx_search_backward": (MATCH, {"flags": "", "start": -1}, lambda rx, t, start: _to_match(api.search_backward(rx, t, int(start)))),
}


def _udf(kind: str, defaults: dict, fn):
    names, struct = list(defaults), kind == MATCH

    def one(t, p, *given):
        if t is None or p is None or any(x is None for x in given):
            return None
        args = {**defaults, **dict(zip(names, given))}
        return fn(api.regex(p, args.pop("flags")), t, *args.values())

    def rows(cols):
        if len(cols) > 2 + len(names):
            raise TypeError(f"at most {2 + len(names)} arguments: text, pattern, {', '.join(names)}")
        clean = [[None if pd.isna(x) else x for x in c] for c in cols]
        return [one(*r) for r in zip(*clean)]

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(rows(cols), dtype=object)

    def run_struct(*cols: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([r or {"found": None, "boundaries": None} for r in rows(cols)], columns=["found", "boundaries"])

    return F.pandas_udf(run_struct if struct else run, kind_of(kind))


class _FindAll:
    """(match_no, group_no, a, b, text) of all matches and groups; unset groups have null text."""

    def eval(self, subject: str, pattern: str, flags: str = ""):
        if subject is None or pattern is None:
            return
        for n, m in enumerate(api.find_all(api.regex(pattern, flags), subject)):
            for g, (a, b) in enumerate(m):
                yield n, g, a, b, api.span_text(subject, (a, b))


def find_all_table():
    return F.udtf(_FindAll, returnType="match_no: int, group_no: int, a: int, b: int, text: string")


def register(spark: SparkSession) -> None:
    """Register rx_* functions and the table function rx_find_all (for LATERAL)."""
    bound_batches()
    for name, (kind, defaults, fn) in FUNCTIONS.items():
        spark.udf.register(name, _udf(kind, defaults, fn))
    spark.udtf.register("rx_find_all", find_all_table())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: String literals and comments, which hold no calls, and the names of calls.
_TOKEN = re.compile(r"""(?P<skip>[rR]?'(?:[^'\\]|\\.|'')*'|[rR]?"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\b(?P<call>rx_\w+)\s*\(|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<comma>,)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}


def _literal(text: str):
    """The value of a string or integer literal; None if it is none."""
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    raw = text[:1] in "rR"
    body = text[1:] if raw else text
    if len(body) < 2 or body[0] not in "'\"" or body[-1] != body[0] or (m := _TOKEN.match(text)) is None or m["skip"] != text:
        return None
    inner = body[1:-1].replace(body[0] * 2, body[0]) if not raw else body[1:-1]
    if raw:
        return inner
    if re.search(r"\\[uU0-9]", inner.replace("\\\\", "")) and not re.search(r"\\0(?!\d)", inner):
        return None  # numbered escapes are left to Spark
    return re.sub(r"\\(.)", lambda m: "\\" + m[1] if m[1] in "%_" else _ESCAPES.get(m[1], m[1]), inner, flags=re.S)


def native_call(name: str, subject: str, pattern: str, *given) -> str | None:
    """SQL of built-in functions for a call of an rx function with constant arguments; None if it must run in the kernel."""
    _, defaults, _ = FUNCTIONS[name]
    if len(given) > len(defaults):
        return None
    args = {**defaults, **dict(zip(defaults, given))}
    rx = api.regex(pattern, args["flags"])
    op = {"rx_matches": "matches", "rx_find": "find", "rx_extract": "extract", "rx_find_all_text": "find_all", "rx_count": "count", "rx_replace": "replace", "rx_split": "split", "rx_find_backward": "backward"}.get(name)
    if op is None or args.get("start", 0) not in (0, -1) or args.get("count"):
        return None
    g = _group(rx, args["group"]) if "group" in args else 0
    p = plan(rx, "find" if op == "extract" and g == 0 else op, start=args["start"] + 1 if op == "backward" else args.get("start", 0))
    if p.native is None:
        return None
    t, java = f"({subject})", p.native.pattern
    k = _quoted(java)
    if op == "matches":
        return f"contains({t}, {_quoted(p.native.literal)})" if p.native.literal is not None else f"(contains({t}, {_quoted(p.native.required)}) AND {t} RLIKE {k})" if p.native.required else f"({t} RLIKE {k})"
    if op in ("find", "extract"):
        if g < 0:
            return "CAST(NULL AS STRING)"
        if g == 0 or _surely(rx, g):
            return f"CASE WHEN {t} RLIKE {k} THEN regexp_extract({t}, {k}, {p.native.groups[g - 1] if g else p.native.keep[1]}) END"
        m = marked(rx.pattern, rx.flags)
        if m is None:
            return None
        took = _quoted(rf"\A(?>[\s\S]*?(?>{m.pattern}))\{m.marks[g - 1]}(?:)")
        return f"CASE WHEN {t} RLIKE {took} THEN regexp_extract({t}, {k}, {p.native.groups[g - 1]}) END"
    if op == "find_all":
        return f"regexp_extract_all({t}, {k}, {p.native.groups[g - 1] if g > 0 else p.native.keep[1]})" if g <= 0 or (_surely(rx, g) and not p.native.loose) else None
    if op == "count":
        return f"regexp_count({t}, {k})"
    if op == "replace":
        return f"regexp_replace({t}, {k}, {_quoted(java_template(rx, p.native, args['template']))})"
    if op == "split":
        return None if rx.capture_count else f"split({t}, {k}, {args['max_split'] + 1 if args['max_split'] else -1})"
    back = _quoted(rf"\A[\s\S]*({_shifted(java)})")
    return f"CASE WHEN {t} RLIKE {k} THEN regexp_extract({t}, {back}, 1) END"


def rewrite(text: str) -> str:
    """The query with its rx calls of constant patterns as built-in functions, where they can run natively."""
    out, at, p = [], 0, 0
    while m := _TOKEN.search(text, p):
        p = m.end()
        if not m["call"] or m["call"].lower() not in FUNCTIONS:
            continue
        # the call's arguments, split at its own commas
        depth, args, begin, q = 1, [], p, p
        while depth and (x := _TOKEN.search(text, q)):
            q = x.end()
            depth += bool(x["open"] or x["call"]) - bool(x["close"])
            if depth == 0 or (depth == 1 and x["comma"]):
                args.append(text[begin : x.start()])
                begin = q
        if depth or len(args) < 2:
            continue
        values = [_literal(a) for a in args[1:]]
        if any(v is None for v in values) or not isinstance(values[0], str):
            continue
        got = native_call(m["call"].lower(), rewrite(args[0]).strip(), *values)
        if got is not None:
            out += [text[at : m.start()], got]
            at = p = q
    return "".join([*out, text[at:]])


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a query with rx functions; see the module. Registers them if they aren't known."""
    if not spark.catalog.functionExists("rx_matches"):
        register(spark)
    return spark.sql(rewrite(text))
