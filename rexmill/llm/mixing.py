"""Mixing sources to target weights by cube-method balanced sampling.

A document of source s is wanted ``e_s = target_s / size_s`` times on average.
``floor(e_s)`` copies are certain; one more is taken with probability
``p = e_s - floor(e_s)``. The cube method picks these so that the totals of
tokens and of documents of every source stay at their expected values: its
flight phase moves the vector of probabilities through the null space of the
two balancing constraints until all but a few entries are 0 or 1. A source's
largest documents, which a block couldn't balance, come first, and the others'
probabilities make up for what was decided. The flight runs in blocks of a source, then again over what the blocks left, until a source's rest
is one block. There the flight leaves the smallest documents out; they and what
the flight leaves open are the landing problem, which is solved by trying all
choices: whole copies that bring the total of tokens, then that of documents,
nearest to what is expected. So every document is taken a whole number of times.

Targets are found by rounds of sums over the table of sources, so their number
is not bounded by the driver's memory.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, scratched, stash

#: Weights of the sources by code point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
MOST = 3
#: Rows of a block of the flight phase, about.
BLOCK = 2_000
#: Documents that the last flight of a source leaves to the landing.
LANDING = 14
#: A document is large if so many of its size are more than its source is expected to add by chance, or than LARGE_SHARE of it;
#: so a source has no more than LARGE / LARGE_SHARE of them.
LARGE, LARGE_SHARE = 25, 0.04
#: Equal rows that are written out by one task.
CHUNK = 4_096
_EPS = 1e-9


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct ``source``) with ``rank`` from 0 by code point, null last.

    Sorted by ranges; only the number of rows of each range reaches the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stash(rows.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "mix-ranks")
    before, offsets = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    offset = sources.sparkSession.createDataFrame(offsets, "part long, before long")
    return rows.join(F.broadcast(offset), "part").withColumn("rank", F.col("before") + F.col("i")).drop("part", "i", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all sizes by weight, none above most * source_size.

    The excess of a source that is above is reshared by weight among the others,
    in rounds until none is. A source of size 0 gets 0.
    """
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    state = stash(ranked(sources).withColumn("w", by_rank).withColumn("full", F.lit(False)), "mix-targets")
    free = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0))
    used = F.sum(F.when(F.col("full"), most * F.col("source_size")).otherwise(0))
    while True:
        s = state.agg(free.alias("w"), (F.sum("source_size") - used).alias("left")).first()
        share = F.lit(float(s["left"] or 0)) * F.col("w") / F.lit(s["w"] or 1.0)
        above = ~F.col("full") & (share > most * F.col("source_size"))
        if state.filter(above).limit(1).count() == 0:
            return state.withColumn("target", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share)).drop("rank", "w", "full")
        state = stash(state.withColumn("full", F.col("full") | above), "mix-targets")


def flight(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Move p until at most two entries are strictly between 0 and 1, keeping x.T @ p; x has two columns.

    Works on x.shape[1] + 1 entries at a time; the direction alternates between
    the two ends of each null-space segment, so the same input gives the same
    result. Rows of x are the balancing variables of one unit.
    """
    p, eps = p.astype(float).copy(), 1e-9
    k = x.shape[1] + 1
    todo = iter(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist())
    hand: list[int] = []
    coin = 0.5
    while True:
        while len(hand) < k and (i := next(todo, None)) is not None:
            hand.append(i)
        if len(hand) < k:
            return p
        a, b, c = (x[i] for i in hand)
        u = (b[0] * c[1] - b[1] * c[0], c[0] * a[1] - c[1] * a[0], a[0] * b[1] - a[1] * b[0])
        if not any(abs(v) > eps for v in u):  # dependent units: move two against each other
            i, j = (0, 1) if a[1] or b[1] or not c[1] else (0, 2)
            u = [0.0, 0.0, 0.0]
            u[i], u[j] = (x[hand[j]][1] or 1.0), -(x[hand[i]][1] or 1.0)
        up = min(((1 - p[i]) / v if v > 0 else -p[i] / v) for i, v in zip(hand, u) if abs(v) > eps)
        down = min((p[i] / v if v > 0 else (p[i] - 1) / v) for i, v in zip(hand, u) if abs(v) > eps)
        coin = (coin * 5.372 + 0.61803398875) % 1.0  # a fixed low-discrepancy walk instead of a random number
        step = up if coin * (up + down) < down else -down
        for i, v in zip(hand, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        hand = [i for i in hand if eps < p[i] < 1 - eps]


def landing(p: np.ndarray, size: np.ndarray, total: float) -> np.ndarray:
    """The 0/1 choice for units with fractions p whose sum of sizes is nearest to ``total``, then whose number is nearest to sum(p)."""
    n = len(p)
    pick = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(pick @ size - total)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    return pick[near[np.argmin(np.abs(pick[near].sum(axis=1) - p.sum()), keepdims=True)][0]].astype(float)


def _fly(last: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    """Flight over a block, from the largest documents to the smallest; with ``last``, landing as well."""
    pdf = pdf.sort_values(["size", "h", "no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, p = pdf["size"].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float)
    held = min(LANDING, len(p)) if last else 0
    fly = len(p) - held
    out = np.r_[flight(p[:fly], np.column_stack([np.ones(fly), size[:fly]])), p[fly:]]
    if last:
        open_ = np.flatnonzero((out > _EPS) & (out < 1 - _EPS))
        # what the flight has settled is balanced with the rest, up to rounding
        out[open_] = landing(out[open_], size[open_], float(size @ p) - float(size @ np.where((out > _EPS) & (out < 1 - _EPS), 0, out)))
    return pdf.assign(p=np.clip(np.where(out < _EPS, 0.0, np.where(out > 1 - _EPS, 1.0, out)), 0, 1))


@scratched
def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """How often a mix takes each document; see the module.

    docs: columns ``doc_id, text, source``; others are ignored. Returns one row
    per input row: ``doc_id, size, source, source_size, target, copies, taken``
    (copies * size). A null text has size 0; a null source is a source of its
    own, last in order; a null doc_id is an id like others. Rows of size 0 and
    sources of size 0 are taken ``floor`` times (0 words). Equal rows are one
    unit with their number: as many of them as their expected copies hold are
    settled at once, and at most one is left to chance. A source's total misses
    its target by no more than what no choice of whole copies in its landing
    could reach. The same rows give the same result in whatever order they
    come; an empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    given = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sized = stash(given.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("c")), "mix-sizes", keep=True)
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count("*").alias("n"))
    plan = targets(per, weights, most)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(e + 1e-12), F.lit(most)).cast("int")
    chance = F.when(base < most, F.least(F.greatest(e - base, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    plan = stash(plan.select(F.col("source").alias("of"), "source_size", "target", base.alias("base"), chance.alias("chance"), F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("blocks")), "mix-plan", keep=True)
    # of c equal rows floor(c * chance) are taken once more, and one with the fraction that is left
    many = F.col("c") * F.col("chance")
    sure = F.floor(many + _EPS)
    units = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).withColumn("sure", sure.cast("long")).withColumn("p", F.greatest(many - sure, F.lit(0.0)))
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS) & (F.col("size") > 0)
    cols = ["source", "size", "h", "no", "p"]
    kind = "source string, size long, h long, no long, p double"
    units = units.withColumn("no", F.xxhash64("doc_id", "size", "h"))
    left = units.filter(open_)
    large = F.col("size") * LARGE > F.greatest(F.col("chance"), F.lit(LARGE_SHARE)) * F.col("source_size")
    first = stash(left.filter(large).select(*cols).groupBy("source").applyInPandas(functools.partial(_source, cols), kind), "mix-large", keep=True)
    words = F.sum(F.col("size") * F.col("p"))
    given = left.groupBy(F.col("source").alias("s")).agg(words.alias("all"), F.sum(F.when(~large, F.col("size") * F.col("p")).otherwise(0.0)).alias("rest"), F.sum((~large).cast("long")).alias("n"))
    spent = first.groupBy(F.col("source").alias("z")).agg(words.alias("spent"))
    ratio = given.join(spent, given["s"].eqNullSafe(spent["z"]), "left").select("s", "n", F.greatest((F.col("all") - F.coalesce("spent", F.lit(0.0))) / F.greatest(F.col("rest"), F.lit(_EPS)), F.lit(0.0)).alias("ratio"))
    ratio = stash(ratio, "mix-ratios")
    rest = ratio.agg(F.max("n")).first()[0] or 0
    left = left.filter(~large).join(ratio.select("s", "ratio"), left["source"].eqNullSafe(ratio["s"])).withColumn("p", F.least(F.col("p") * F.col("ratio"), F.lit(1.0)))
    left = stash(left.select(*cols, F.pmod(F.xxhash64("no", "h"), F.col("blocks")).cast("int").alias("b")), "mix-open", keep=True)
    settled = (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
    counts = F.max("n")
    done, turn, state = [first, left.filter(settled).select(*cols)], 0, left.filter(~settled)
    # a block of each source is kept for its landing; the others leave two rows each at most, over which it is
    # flown again until a source's rest is one block
    held, state = state.filter("b = 0"), state.filter("b <> 0")
    while rest > block:
        state = stash(state.groupBy("source", "b").applyInPandas(functools.partial(_block, cols), kind), "mix-flight", keep=True)
        done.append(state.filter(settled))
        state, turn = state.filter(~settled), turn + 1
        rest = state.groupBy("source").agg(F.count("*").alias("n")).agg(counts).first()[0] or 0
        state = state.withColumn("b", F.pmod(F.xxhash64("h", "no", F.lit(turn)), F.lit(-(-rest // block))).cast("int"))
    done.append(held.select(*cols).unionByName(state.select(*cols)).groupBy("source").applyInPandas(functools.partial(_source, cols), kind))
    chosen = done[0]
    for part in done[1:]:
        chosen = chosen.unionByName(part)
    chosen = stash(chosen.filter(F.col("p") > 0.5).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("h").alias("g"), F.col("no").alias("m")), "mix-chosen", keep=True)
    same = units["source"].eqNullSafe(chosen["s"]) & (units["size"] == chosen["z"]) & (units["h"] == chosen["g"]) & (units["no"] == chosen["m"])
    got = units.join(chosen, same, "left").withColumn("more", F.col("sure") + F.col("m").isNotNull().cast("long"))
    # equal rows are written out again; a hot one's in chunks, which are dealt to several tasks
    count_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = got.filter(F.col("c") <= CHUNK).withColumn("copy", F.explode(count_to(F.col("c"))))
    hot = got.filter(F.col("c") > CHUNK).withColumn("chunk", F.explode(count_to(F.ceil(F.col("c") / CHUNK)))).repartition("h", "chunk")
    from_ = F.col("chunk") * CHUNK
    hot = hot.withColumn("copy", F.explode(F.sequence(from_, F.least(from_ + CHUNK, F.col("c")) - 1))).drop("chunk")
    each = few.unionByName(hot)
    copies = F.col("base") + (F.col("copy") < F.col("more")).cast("int")
    return each.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _block(cols: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(False, pdf)[cols]


def _source(cols: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(True, pdf)[cols]
