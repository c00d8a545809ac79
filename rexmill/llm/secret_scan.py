"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A
ledger says for each blob which rules, at which versions, it was scanned by, and
what they found. A scan takes only the pairs of blob and rule version that the
ledger lacks, and findings are joined from the ledger back to all paths that
hold the blob, whichever scan they are from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    base: bool = False


#: The three base rules, in the order of ties (fixed by the contract), then the ones added here.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 16, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{30,}"),
)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _hits(text: Column, rule: Rule) -> Column:
    """Array of (gap, match): the characters between a match and the one before, and its text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), F.length)
    empty = F.array().cast("array<struct<gap:int,hit:string>>")
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit")).cast("array<struct<gap:int,hit:string>>")
    return F.when(text.rlike(rule.pattern), pairs).otherwise(empty)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, only: tuple[int, ...] | None = None) -> DataFrame:
    """blob, text -> blob, rule, start, end of every finding (code points, end exclusive); rule is an index into rules.

    Leftmost non-overlapping per rule. ``only``: the rules to scan by. If blobs
    has a column ``todo`` (array of rule indexes), a blob is scanned by those
    alone. Positions are running sums over a blob's matches, so the work is
    linear in their number.
    """
    some = range(len(rules)) if only is None else only
    empty = F.array().cast("array<struct<gap:int,hit:string>>")
    hits = {i: _hits(F.col("text"), rules[i]) for i in some}
    if "todo" in blobs.columns:
        hits = {i: F.when(F.array_contains("todo", i), h).otherwise(empty) for i, h in hits.items()}
    by_rule = F.array(*[F.struct(F.lit(i).alias("rule"), h.alias("hits")) for i, h in hits.items()])
    each = blobs.select("blob", F.explode(F.filter(by_rule, lambda x: F.size(x["hits"]) > 0)).alias("r"))
    rows = each.select("blob", F.col("r.rule").alias("rule"), F.posexplode("r.hits").alias("i", "h"))
    w = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("blob", "rule", "i", F.col("h.gap").alias("gap"), F.col("h.hit").alias("hit"), F.length("h.hit").alias("n"))
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)).withColumn("start", F.col("end") - F.col("n"))
    kept = F.lit(False)
    for i in some:
        r = rules[i]
        size = F.length(F.regexp_extract("hit", r.pattern, r.group)) if r.group else F.col("n")
        kept = kept | ((F.col("rule") == i) & (size >= r.least))
    return rows.filter(kept).select("blob", "rule", "start", "end")


#: A ledger: one row of each blob and scan, with the rule versions scanned by and their findings.
LEDGER = "blob string, scans array<struct<kind:string,version:int>>, spans array<struct<start:bigint,kind:string,version:int,end:bigint>>"


def _versions(history: DataFrame) -> DataFrame:
    """blob, text of every row; a null text counts as empty."""
    return history.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))


def update_ledger(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (LEDGER) for the pairs of blob and rule version that ``ledger`` lacks.

    history: ``text`` (null counts as empty) and any columns of paths and
    versions. Only unseen pairs are scanned: rules that no blob lacks aren't in
    the plan, and of the others a blob runs those it lacks. A blob without
    findings gets a row as well, so it isn't scanned again; one that lacks
    nothing gets none. Rules are told by kind and version.
    """
    pair = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
    listed = F.array(*[pair(r) for r in rules])
    if ledger is None:
        given = _versions(history).select("blob").distinct()
        found, scans = scan_blobs(_versions(history).dropDuplicates(["blob"]), rules), listed
    else:
        seen = ledger.select("blob", F.explode("scans").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("seen"))
        lacks = lambda i: ~F.coalesce(F.array_contains("seen", pair(rules[i])), F.lit(False))
        todo = F.filter(F.array(*[F.when(lacks(i), F.lit(i)) for i in range(len(rules))]), lambda i: i.isNotNull())
        given = _versions(history).select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
        given = stash(given, "secret-todo")
        # which rules are in the plan at all: one number for each rule
        some = given.agg(*[F.max(F.array_contains("todo", i)).alias(str(i)) for i in range(len(rules))]).first()
        only = tuple(i for i in range(len(rules)) if some[i])
        if not only:
            return history.sparkSession.createDataFrame([], LEDGER)
        found, scans = scan_blobs(_versions(history).join(given, "blob").dropDuplicates(["blob"]), rules, only), F.transform("todo", lambda i: F.element_at(listed, i + 1))
    name = F.element_at(listed, F.col("rule") + 1)
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", name["kind"].alias("kind"), name["version"].alias("version"), "end"))).alias("spans"))
    out = given.join(spans, "blob", "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,version:int,end:bigint>>")
    return out.select("blob", scans.alias("scans"), F.coalesce("spans", none).alias("spans"))


def findings_by_path(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of history, without text, with ``spans: array<struct<start,rule,end>>`` in order of start, then rule.

    The findings of the given rule versions in all scans of the ledger; other
    versions' aren't taken. A blob that the ledger lacks has none.
    """
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    each = ledger.filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    each = each.select("blob", F.struct(F.col("s.start").alias("start"), F.element_at(number, F.concat_ws(":", "s.kind", "s.version")).alias("rule"), F.col("s.end").alias("end")).alias("s")).filter("s.rule is not null")
    # a table of its own, so that a hot blob's paths can be dealt to several tasks
    per_blob = stash(each.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans")), "secret-spans")
    keyed = history.withColumn("blob", blob_id(F.col("text"))).drop("text")
    return keyed.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")))


def scan_paths(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger up to date with a history; returns (findings_by_path, the whole ledger).

    history: any columns beside ``text``, but for ``blob`` and ``spans``, which are the result's own.
    """
    new = stash(update_ledger(history, ledger, rules), "secret-ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings_by_path(history, whole, rules), whole


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds and the spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")

    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")
    only_base = F.filter("spans", lambda s: s["rule"].isin(base))
    return found.select("doc_id", *[count(i).alias(f"n_{rules[i].kind}") for i in base], F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
