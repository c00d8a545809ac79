"""Column functions. Each takes a column and a pattern (with flags) and plans its tier.

Null subjects give null. A pattern is checked when the expression is built.
``tier="kernel"`` forces the kernel (tests compare the tiers).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import api
from ..operators.api import Regex, regex
from ..operators.vm import CALL_LIMIT, STEP_LIMIT
from ..plans.planner import Plan, java_template, marked, plan

SPAN = "struct<a:int,b:int>"
MATCH = f"struct<found:boolean,boundaries:array<{SPAN}>>"
_DEFAULTS = {"step_limit": STEP_LIMIT, "call_limit": CALL_LIMIT}


#: Bytes of an Arrow batch that a Python worker is sent, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20


def bound_batches() -> None:
    """Batches of bounded bytes for the session's Python workers (a longer row comes alone), unless it has a bound of its own.

    A worker holds a batch several times over: as it came, as texts, and with
    the results. Spark's own bound is 64 MB, in each worker of each core.
    """
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if session is not None and session.conf.get(key, None) is None:
        session.conf.set(key, str(BATCH_BYTES))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _planned(c, pattern, flags, op, tier, **how) -> tuple[Column, Regex, Plan]:
    rx = regex(pattern, flags)
    p = plan(rx, op, **how)
    if tier == "kernel" and p.native is not None:
        p = Plan("kernel", "forced", None, p.required, p.min_width)
    return _col(c), rx, p


def _limits(limits: dict) -> dict:
    if bad := set(limits) - {*_DEFAULTS, "on_error"}:
        raise TypeError(f"unknown options {sorted(bad)}")
    return limits


def _kernel(c: Column, p: Plan, fn: Callable, kind: str, missing=None, limits: dict | None = None) -> Column:
    """Run fn(text, **limits) on the rows that hold the required literal; others get ``missing``."""
    limits = dict(limits or {})
    null_errors = limits.pop("on_error", "raise") == "null"
    bound_batches()

    def one(text):
        if text is None:
            return None
        try:
            return fn(text, **limits)
        except api.PatternError:
            if null_errors:
                return None
            raise

    parsed = T._parse_datatype_string(kind)
    names = parsed.names if isinstance(parsed, T.StructType) else []

    def each(s: pd.Series) -> list:
        """Results of a batch; a text that it repeats is searched once."""
        known: dict = {}
        for t in s:
            if t not in known:
                known[t] = one(t)
        return [known[t] for t in s]

    @F.pandas_udf(parsed)
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(each(s), dtype=object)

    @F.pandas_udf(parsed)
    def udf_struct(s: pd.Series) -> pd.DataFrame:
        rows = each(s)
        return pd.DataFrame([r if r is not None else dict.fromkeys(names) for r in rows], columns=names)

    run = udf_struct if names else udf
    if not p.required or missing is None:
        return run(c)
    # functions in Python aren't skipped by conditions, so the rows are blanked instead
    hit = F.contains(c, F.lit(p.required))
    return F.when(hit, run(F.when(hit, c))).when(c.isNotNull(), missing)


def _to_match(m):
    return {"found": m is not None, "boundaries": [{"a": a, "b": b} for a, b in m or ()]}


def _no_match() -> Column:
    return F.struct(F.lit(False).alias("found"), F.array().cast(f"array<{SPAN}>").alias("boundaries"))


def matches(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """Does the pattern occur? A required literal is tested first, which Parquet can skip by."""
    c, rx, p = _planned(c, pattern, flags, "matches", tier)
    if p.native is None:
        got = _kernel(c, p, lambda t, **k: api.search(rx, t, **k) is not None, "boolean", F.lit(False), _limits(limits))
        return F.contains(c, F.lit(p.required)) & got if p.required else got
    if p.native.literal is not None:
        return F.contains(c, F.lit(p.native.literal))
    hit = c.rlike(p.native.pattern)
    return F.contains(c, F.lit(p.native.required)) & hit if p.native.required else hit


def find(c, pattern, flags: str = "", start: int = 0, tier: str = "", **limits) -> Column:
    """Text of the leftmost match, null without one."""
    c, rx, p = _planned(c, pattern, flags, "find", tier, start=start)
    if p.native is not None:
        return F.when(c.rlike(p.native.pattern), F.regexp_extract(c, p.native.pattern, p.native.keep[1]))

    def fn(t, **k):
        m = api.search(rx, t, start, **k)
        return api.span_text(t, m[0]) if m else None

    return _kernel(c, p, fn, "string", F.lit(None).cast("string") if not start else None, _limits(limits))


def _native_span(c: Column, pattern: str, anchored: bool = False) -> Column:
    """Byte span of the leftmost match, or of one at the beginning, where there is one."""
    size = F.octet_length(F.regexp_extract(c, rf"\A(?:{pattern})" if anchored else pattern, 0))
    head = F.lit(0) if anchored else F.octet_length(F.regexp_extract(c, rf"\A([\s\S]*?)(?:{_shifted(pattern)})", 1))
    return F.struct(head.alias("a"), (head + size).alias("b"))


def find_span(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """Byte span of the leftmost match; (-1, -1) without one."""
    c, rx, p = _planned(c, pattern, flags, "span", tier)
    unset = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    if p.native is not None:
        return F.when(c.rlike(p.native.pattern), _native_span(c, p.native.pattern)).when(c.isNotNull(), unset)

    def fn(t, **k):
        a, b = api.match_span(api.search(rx, t, **k))
        return {"a": a, "b": b}

    return F.when(c.isNotNull(), _kernel(c, p, fn, SPAN, unset, _limits(limits)))


def find_struct(c, pattern, flags: str = "", start: int = 0, tier: str = "", **limits) -> Column:
    """found and boundaries of the leftmost match: byte spans of the match and all groups. Native without groups."""
    c, rx, p = _planned(c, pattern, flags, "spans", tier, start=start)
    if p.native is not None:
        hit = F.struct(F.lit(True).alias("found"), F.array(_native_span(c, p.native.pattern)).alias("boundaries"))
        return F.when(c.rlike(p.native.pattern), hit).when(c.isNotNull(), _no_match())
    return F.when(c.isNotNull(), _kernel(c, p, lambda t, **k: _to_match(api.search(rx, t, start, **k)), MATCH, _no_match() if not start else None, _limits(limits)))


def match_at(c, pattern, pos: int = 0, flags: str = "", tier: str = "", **limits) -> Column:
    """found and boundaries of a match that begins exactly at byte ``pos``. Native at 0 without groups."""
    c, rx, p = _planned(c, pattern, flags, "spans", tier, start=pos)
    if p.native is not None:
        hit = F.struct(F.lit(True).alias("found"), F.array(_native_span(c, p.native.pattern, anchored=True)).alias("boundaries"))
        return F.when(c.rlike(rf"\A(?:{p.native.pattern})"), hit).when(c.isNotNull(), _no_match())
    return F.when(c.isNotNull(), _kernel(c, p, lambda t, **k: _to_match(api.match_at(rx, t, pos, **k)), MATCH, None, _limits(limits)))


def starts_with(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """Does a match begin at position 0?"""
    c, rx, p = _planned(c, pattern, flags, "match_at", tier)
    if p.native is not None:
        if p.native.literal is not None:
            return F.startswith(c, F.lit(p.native.literal))
        return c.rlike(rf"\A(?:{p.native.pattern})")
    return _kernel(c, p, lambda t, **k: api.match_at(rx, t, 0, **k) is not None, "boolean", F.lit(False), _limits(limits))


def find_backward(c, pattern, flags: str = "", start: int = -1, tier: str = "", **limits) -> Column:
    """Text of the match with the rightmost start."""
    c, rx, p = _planned(c, pattern, flags, "backward", tier, start=start + 1)
    if p.native is not None:
        full = rf"\A[\s\S]*({_shifted(p.native.pattern)})"
        return F.when(c.rlike(p.native.pattern), F.regexp_extract(c, full, 1))

    def fn(t, **k):
        m = api.search_backward(rx, t, start, **k)
        return api.span_text(t, m[0]) if m else None

    return _kernel(c, p, fn, "string", F.lit(None).cast("string") if start < 0 else None, _limits(limits))


def _shifted(pattern: str) -> str:
    """Group references one higher, for a pattern that is put into a group."""
    return re.sub(r"\\(\d+)\(\?:\)", lambda m: f"\\{int(m[1]) + 1}(?:)", pattern)


def backward_struct(c, pattern, flags: str = "", start: int = -1, **limits) -> Column:
    c, rx, p = _planned(c, pattern, flags, "spans", "")
    return F.when(c.isNotNull(), _kernel(c, p, lambda t, **k: _to_match(api.search_backward(rx, t, start, **k)), MATCH, None, _limits(limits)))


def _group_text(c: Column, rx: Regex, p: Plan, i: int) -> Column | None:
    """Text of group i where the pattern occurs, null if it took no part; None if Java can't tell."""
    if i == 0 or _surely(rx, i):
        return F.regexp_extract(c, p.native.pattern, p.native.groups[i - 1] if i else p.native.keep[1])
    m = marked(rx.pattern, rx.flags)
    if m is None:
        return None
    # the first match as a whole, then whether the group's mark is set in it
    took = c.rlike(rf"\A(?>[\s\S]*?(?>{m.pattern}))\{m.marks[i - 1]}(?:)")
    return F.when(took, F.regexp_extract(c, p.native.pattern, p.native.groups[i - 1]))


def extract(c, pattern, group: int | str = 0, flags: str = "", tier: str = "", **limits) -> Column:
    """Text of a group of the leftmost match; null if there is no match or the group took no part."""
    c, rx, p = _planned(c, pattern, flags, "extract" if group else "find", tier)
    i = rx.capture_index(group) if isinstance(group, str) else group
    if i < 0 or i > rx.capture_count:
        return F.lit(None).cast("string")
    if p.native is not None and (got := _group_text(c, rx, p, i)) is not None:
        return F.when(c.rlike(p.native.pattern), got)

    def fn(t, **k):
        m = api.search(rx, t, **k)
        return api.span_text(t, m[i]) if m else None

    return _kernel(c, p, fn, "string", F.lit(None).cast("string"), _limits(limits))


def _surely(rx: Regex, i: int) -> bool:
    """Does group i take part in every match?"""
    from ..plans import nodes as N

    def sure(n) -> bool:
        if isinstance(n, N.Group):
            return n.index == i or sure(n.body)
        if isinstance(n, N.Cat):
            return any(sure(x) for x in n.items)
        if isinstance(n, N.Rep):
            return n.lo > 0 and sure(n.body)
        return isinstance(n, N.Atomic) and sure(n.body)

    return sure(rx.compiled.root)


def extract_struct(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """A struct of all groups' texts, named by the groups or g1, g2, ...; null without a match."""
    c, rx, p = _planned(c, pattern, flags, "extract", tier)
    names: dict[str, int] = {}
    for name, i in rx.named_captures or [(f"g{i}", i - 1) for i in range(1, rx.capture_count + 1)]:
        names.setdefault(name, i + 1)
    if p.native is not None:
        texts = {n: _group_text(c, rx, p, i) for n, i in names.items()}
        if texts and all(t is not None for t in texts.values()):
            return F.when(c.rlike(p.native.pattern), F.struct(*[t.alias(n) for n, t in texts.items()]))

    def fn(t, **k):
        m = api.search(rx, t, **k)
        return [api.span_text(t, m[i]) for i in names.values()] if m else None

    got = _kernel(c, p, fn, "array<string>", F.lit(None).cast("array<string>"), _limits(limits))
    return F.when(got.isNotNull(), F.struct(*[F.element_at(got, k + 1).alias(n) for k, n in enumerate(names)]))


def find_all(c, pattern, group: int = 0, flags: str = "", tier: str = "", **limits) -> Column:
    """Texts of all matches, or of a group of each (null where it took no part)."""
    c, rx, p = _planned(c, pattern, flags, "find_all", tier)
    if p.native is not None and (group == 0 or (_surely(rx, group) and not p.native.loose)):
        return F.regexp_extract_all(c, F.lit(p.native.pattern), F.lit(p.native.groups[group - 1] if group else p.native.keep[1]))
    fn = lambda t, **k: api.find_all_text(rx, t, group, **k)
    return _kernel(c, p, fn, "array<string>", F.array().cast("array<string>"), _limits(limits))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, though ``then`` may use it in lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running_spans(gaps: Column) -> Column:
    """Spans of matches from an array of (gap before it, size), in bytes.

    Sums run within chunks of about the root of the number of matches and over
    the chunks, so arrays that grow by one element at a time stay short.
    """
    one = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))

    def spans(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        chunks = F.sequence(F.lit(0), F.ceil(F.size(p) / size).cast("int") - 1)
        part = lambda k: F.slice(p, k * size + 1, size)
        total = lambda k: F.aggregate(part(k), F.lit(0), lambda t, x: t + x["gap"] + x["size"])
        begins = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + total(k))))

        def chunk(k, at):
            begin = F.element_at(at, k + 1)
            start = F.array(F.struct(begin.alias("a"), begin.alias("b")))

            def add(acc, x):
                end = F.element_at(acc, -1)["b"] + x["gap"]
                return F.concat(acc, F.array(F.struct(end.alias("a"), (end + x["size"]).alias("b"))))

            return F.slice(F.aggregate(part(k), start, add), F.lit(2), size)

        return _let(begins, lambda at: F.flatten(F.transform(chunks, lambda k: chunk(k, at))))

    empty = F.slice(F.array(one), 1, 0)
    return _let(gaps, lambda p: F.when(F.size(p) == 0, empty).otherwise(spans(p)))


def find_all_spans(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """All matches as arrays of byte spans: the match and its groups. Native without groups."""
    c, rx, p = _planned(c, pattern, flags, "find_all_spans", tier)
    kind = f"array<array<{SPAN}>>"
    if p.native is not None:
        found = F.regexp_extract_all(c, F.lit(p.native.pattern), F.lit(0))
        zipped = F.slice(F.arrays_zip(F.split(c, p.native.pattern, -1).alias("gap"), found.alias("hit")), F.lit(1), F.size(found))
        gaps = F.transform(zipped, lambda x: F.struct(F.octet_length(x["gap"]).alias("gap"), F.octet_length(x["hit"]).alias("size")))
        return F.when(c.isNotNull(), F.transform(_running_spans(gaps), lambda x: F.array(x))).cast(kind)
    fn = lambda t, **k: [[{"a": a, "b": b} for a, b in m] for m in api.find_all(rx, t, **k)]
    return _kernel(c, p, fn, kind, F.array().cast(kind), _limits(limits))


def count(c, pattern, flags: str = "", tier: str = "", **limits) -> Column:
    """Number of matches."""
    c, rx, p = _planned(c, pattern, flags, "count", tier)
    if p.native is not None:
        return F.regexp_count(c, F.lit(p.native.pattern))
    return _kernel(c, p, lambda t, **k: sum(1 for _ in api.find_all(rx, t, **k)), "int", F.lit(0), _limits(limits))


def replace(c, pattern, template: str, count: int = 0, flags: str = "", tier: str = "", **limits) -> Column:
    """Replace all matches (or the first ``count``) by a template: $0 $1 ${name} $$."""
    c, rx, p = _planned(c, pattern, flags, "replace", tier)
    parts = api.template_parts(rx, template)
    if p.native is not None and not count:
        if p.native.literal is not None and "$" not in template:
            return F.replace(c, F.lit(p.native.literal), F.lit(template))
        return F.regexp_replace(c, F.lit(p.native.pattern), F.lit(java_template(rx, p.native, template)))
    if p.native is not None:
        # the pieces around the first matches, with what replaces these; an unset group's text is empty
        texts = {g: F.regexp_extract_all(c, F.lit(p.native.pattern), F.lit(p.native.groups[g - 1] if g else 0)) for g in {x for x in parts if not isinstance(x, str)}}
        pieces = F.split(c, p.native.pattern, count + 1)
        zipped = F.arrays_zip(pieces.alias("piece"), *[t.alias(f"g{g}") for g, t in texts.items()])
        joined = F.transform(zipped, lambda x, i: F.concat(x["piece"], *[F.lit(y) if isinstance(y, str) else F.coalesce(x[f"g{y}"], F.lit("")) for y in parts]))
        # the last piece has no match behind it
        whole = F.concat(F.array_join(F.slice(joined, F.lit(1), F.size(pieces) - 1), ""), F.element_at(pieces, -1))
        return F.when(F.size(pieces) < 2, c).otherwise(whole)
    return _kernel(c, p, lambda t, **k: api.replace(rx, t, template, count, **k), "string", c, _limits(limits))


def replace_with(c, pattern, fn: Callable, count: int = 0, flags: str = "", **limits) -> Column:
    """Replace by what ``fn(spans, subject)`` returns."""
    c, rx, p = _planned(c, pattern, flags, "replace_with", "")
    return _kernel(c, p, lambda t, **k: api.replace_with(rx, t, fn, count, **k), "string", c, _limits(limits))


def split(c, pattern, max_split: int = 0, flags: str = "", tier: str = "", **limits) -> Column:
    """Pieces between matches, with group texts in between."""
    c, rx, p = _planned(c, pattern, flags, "split", tier)
    if p.native is not None:
        pieces = F.split(c, p.native.pattern, max_split + 1 if max_split else -1)
        if not rx.capture_count:
            return pieces
        groups = [F.regexp_extract_all(c, F.lit(p.native.pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(p.native.groups)]
        zipped = F.slice(F.arrays_zip(pieces.alias("piece"), *groups), F.lit(1), F.size(pieces) - 1)
        between = F.flatten(F.transform(zipped, lambda x: F.array(x["piece"], *[x[f"g{i}"] for i in range(len(groups))])))
        return F.concat(between, F.array(F.element_at(pieces, -1)))
    return _kernel(c, p, lambda t, **k: api.split(rx, t, max_split, **k), "array<string>", F.array(c), _limits(limits))


# accessors of find_struct's result


def match_span(m: Column) -> Column:
    return F.coalesce(F.get(m["boundaries"], 0), F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))


def capture_span(m: Column, i: int) -> Column:
    """Span of group i (0-based); (-1, -1) if it is out of range or took no part."""
    unset = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))
    return unset if i < 0 else F.coalesce(F.get(m["boundaries"], i + 1), unset)


def group_count(m: Column) -> Column:
    return F.greatest(F.size(m["boundaries"]) - 1, F.lit(0))


def _index(i: int | str, pattern, flags: str) -> int:
    """0-based number of a group; a name needs the pattern."""
    if isinstance(i, int):
        return i
    if pattern is None:
        raise TypeError("a group's name needs the pattern")
    return regex(pattern, flags).capture_index(i) - 1 if regex(pattern, flags).capture_index(i) > 0 else -1


def captured(m: Column, i: int | str, pattern=None, flags: str = "") -> Column:
    """Did group i (0-based, or a name of ``pattern``) take part? False if there is none."""
    return capture_span(m, _index(i, pattern, flags))["a"] >= 0


def capture_text(c, m: Column, i: int | str, pattern=None, flags: str = "") -> Column:
    """Text of group i (0-based, or a name of ``pattern``) cut from the subject by bytes; null if unset."""
    s = capture_span(m, _index(i, pattern, flags))
    cut = F.decode(F.substr(_col(c).cast("binary"), s["a"] + 1, s["b"] - s["a"]), "UTF-8")
    return F.when(s["a"] >= 0, cut)


def span_text(span: Column) -> Column:
    return F.format_string("%d .. %d", span["a"], span["b"])


def describe(spark, pattern, flags: str = ""):
    """One row: pattern, flags, capture_count, named_captures."""
    rx = regex(pattern, flags)
    kind = "pattern string, flags string, capture_count int, named_captures array<struct<name:string,idx:int>>"
    return spark.createDataFrame([(rx.pattern, rx.flags, rx.capture_count, rx.named_captures)], kind)


def explain(pattern, op: str = "find", flags: str = "") -> str:
    """Tier of an operator, why, Java's pattern, and the tree."""
    rx = regex(pattern, flags)
    p = plan(rx, op)
    return f"{p.tier}: {p.native.pattern if p.native else p.reason}\nrequired literal: {p.required!r}, least width: {p.min_width}\n{rx.compiled.root}"
