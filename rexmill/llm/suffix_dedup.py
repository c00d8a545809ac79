"""Exact substring dedup by blockwise suffix sorting with a difference cover.

Suffixes are dealt into buckets and sorted one bucket at a time. The bucket of
a suffix is the *anchor* of its first ``LENGTH`` bytes: the k-gram there with
the least hash, leftmost on ties. Equal windows have equal anchors, so equal
windows meet in one bucket; neighbouring suffixes mostly share an anchor and
travel as one *run* of bytes. Anchors that the corpus holds at one place only
drop out before any text moves, equal texts and equal runs are counted once
before the shuffle.

In a bucket, suffixes are sorted by their first ``PERIOD`` bytes; longer ties are
settled by ranks of a sample of positions: the positions whose offset modulo
``PERIOD`` is in a difference cover. Any two suffixes reach sampled positions
after an equal step of less than ``PERIOD``. So memory is one bucket's text and
the ranks of its sample. A suffix is repeated if it shares LENGTH bytes with a
neighbour in the order.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded, mix64, slices, stash, to_batch

LENGTH = 200
GRAM = 40
PERIOD = 32
#: Longer texts are cut into overlapping pieces of this size while anchors are computed.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(4)
def difference_cover(v: int) -> tuple[int, ...]:
    """A small set of residues whose differences modulo v are all residues; found greedily."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        best = max((x for x in range(v) if x not in cover), key=lambda x: (len(open_ & {(s * (x - c)) % v for c in cover for s in (1, -1)}), -x))
        cover.append(best)
        open_ -= {(s * (best - c)) % v for c in cover for s in (1, -1)}
    return tuple(sorted(cover))


@functools.lru_cache(4)
def _steps(v: int) -> list[list[int]]:
    """step[a][b]: how far residues a and b must move to be both in the cover."""
    cover = set(difference_cover(v))
    return [[next(d for d in range(v) if (a + d) % v in cover and (b + d) % v in cover) for b in range(v)] for a in range(v)]


def sort_suffixes(texts: list[bytes], starts: list[range], v: int = PERIOD) -> list[tuple[int, int]]:
    """(text, start) of all given suffixes in lexicographic order of the rest of their text."""
    cover = set(difference_cover(v))
    sample = [(i, p) for i, t in enumerate(texts) for p in range(len(t) + 1) if p % v in cover]
    rank: list[dict[int, int]] = [{} for _ in texts]
    sample.sort(key=lambda s: texts[s[0]][s[1] :])
    r, last = -1, None
    for i, p in sample:
        rest = texts[i][p:]
        if rest != last:
            r, last = r + 1, rest
        rank[i][p] = r
    step = _steps(v)

    def compare(x, y):
        d = step[x[1] % v][y[1] % v]
        # a rest that ends within the first v bytes is settled by those bytes
        a, b = rank[x[0]].get(x[1] + d, -1), rank[y[0]].get(y[1] + d, -1)
        return (a > b) - (a < b)

    order = [(texts[i][p : p + v], (i, p)) for i, span in enumerate(starts) for p in span]
    order.sort(key=lambda o: o[0])
    out, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and order[end][0] == order[at][0]:
            end += 1
        tie = [o[1] for o in order[at:end]]
        out += sorted(tie, key=functools.cmp_to_key(compare)) if end - at > 1 else tie
        at = end
    return out


def repeated_starts(texts: list[bytes], length: int = LENGTH, v: int = PERIOD) -> list[list[int]]:
    """For each of several different runs of one bucket, the starts whose ``length`` bytes occur elsewhere in it."""
    order = sort_suffixes(texts, [range(len(t) - length + 1) for t in texts], v)
    found: list[set[int]] = [set() for _ in texts]
    for (i, p), (j, q) in zip(order, order[1:]):
        if texts[i][p : p + length] == texts[j][q : q + length]:
            found[i].add(p)
            found[j].add(q)
    return [sorted(s) for s in found]


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s == out[-1][1]:
            out[-1] = (out[-1][0], s + 1)
        else:
            out.append((s, s + 1))
    return out


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, inverse))


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor position, anchor hash) of all runs of suffix starts."""
    pieces = [(i, o) for i, t in enumerate(texts) for o in range(0, max(1, len(t) - length + 1), PIECE) if len(t) >= length]
    parts = [[], [], [], [], []]
    group, size = [], 0
    for k, (i, o) in enumerate(pieces):
        group.append((i, o))
        size += min(len(texts[i]) - o, PIECE + length - 1)
        if size >= PIECE or k == len(pieces) - 1:
            for part, x in zip(parts, _runs(texts, group, length, gram)):
                part.append(x)
            group, size = [], 0
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


def _runs(texts, group, length, gram):
    cut = [texts[i][o : o + PIECE + length - 1] for i, o in group]
    lens = np.array([len(c) for c in cut], np.int64)
    begin = np.r_[0, np.cumsum(lens)[:-1]]
    b = np.frombuffer(b"".join(cut), np.uint8).astype(np.uint64)
    n, w = len(b), length - gram + 1
    power, inverse = _powers(1 << int(max(n, 2) - 1).bit_length())
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum((b + np.uint64(1)) * power[:n])]
        h = mix64((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    place = np.uint64((1 << 25) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    grid = np.r_[key, np.full(pad, ~np.uint64(0))].reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[: len(key) - w + 1], head[w - 1 : len(key)])
    pos = (least & place).astype(np.int64)  # anchor of the window that starts at each byte
    owner = np.repeat(np.arange(len(cut)), lens)[: len(pos)]
    ok = np.arange(len(pos)) + length <= (begin + lens)[owner]
    first = np.flatnonzero(ok & np.r_[True, (pos[1:] != pos[:-1]) | (owner[1:] != owner[:-1])])
    # a run ends where the next begins or at its piece's last window
    stop = np.minimum(np.r_[first[1:], len(pos)], (begin + lens - length + 1)[owner[first]])
    own = owner[first]
    i, o = np.array([g[0] for g in group], np.int64)[own], np.array([g[1] for g in group], np.int64)[own]
    return i, first - begin[own] + o, stop - first, pos[first] - begin[own] + o, h[pos[first]].view(np.int64)


def _loc(th: np.ndarray, pos: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(th.astype(np.int64).view(np.uint64) ^ mix64(pos.astype(np.int64).view(np.uint64) + np.uint64(1))).view(np.int64)


def _anchors(length, gram, batches):
    schema = pa.schema([("anchor", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("loc", pa.int64())])
    for batch in slices(batches, "bytes", 1 << 20):
        i, _, _, pos, a = runs([t or b"" for t in as_bytes(batch.column("bytes"))], length, gram)
        th = np.asarray(batch.column("th"))[i] if len(i) else np.zeros(0, np.int64)
        yield to_batch(schema, a, th, pos.astype(np.int32), _loc(th, pos))


def _cut_runs(length, gram, batches):
    schema = pa.schema([("anchor", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("loc", pa.int64()), ("content", pa.int64()), ("run", pa.binary())])
    for batch in slices(batches, "bytes", 1 << 20):
        texts, ths, wanted = as_bytes(batch.column("bytes")), np.asarray(batch.column("th")), batch.column("places").to_pylist()
        i, start, count, pos, a = runs(texts, length, gram)
        want = np.zeros(len(i), bool)
        cuts = np.searchsorted(i, np.arange(len(texts) + 1))
        for k, places in enumerate(wanted):
            want[cuts[k] : cuts[k + 1]] = np.isin(pos[cuts[k] : cuts[k + 1]], places)
        i, start, count, a = i[want], start[want], count[want], a[want]
        run = [texts[k][s : s + c + length - 1] for k, s, c in zip(i.tolist(), start.tolist(), count.tolist())]
        content = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) for r in run]
        th = ths[i] if len(i) else np.zeros(0, np.int64)
        yield to_batch(schema, a, th, start.astype(np.int32), _loc(th, start), content, run)


def _bucket(length, v, rows):
    """rows of one bucket: (content, several, run) -> (content, lo, hi) of repeated starts."""
    if len(rows) == 1:
        content, several, run = rows[0]
        return [(content, 0, len(run) - length + 1)] if several else []
    out = []
    for (content, several, run), starts in zip(rows, repeated_starts([r[2] for r in rows], length, v)):
        spans = [(0, len(run) - length + 1)] if several else _ranges(starts)
        out += [(content, lo, hi) for lo, hi in spans]
    return out


def _sort_buckets(length, v, batches):
    schema = pa.schema([("content", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    held, rows, out = None, [], []
    for batch in batches:
        for anchor, content, several, run in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "several", "run"))):
            if anchor != held:
                out += _bucket(length, v, rows) if rows else []
                held, rows = anchor, []
            rows.append((content, several, run))
        if len(out) > 10_000:
            yield to_batch(schema, *map(list, zip(*out)))
            out = []
    out += _bucket(length, v, rows) if rows else []
    if out:
        yield to_batch(schema, *map(list, zip(*out)))


def _strip(batches):
    """th, bytes, whole, spans -> the digest of what is left."""
    schema = pa.schema([("th", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    for batch in slices(batches, "bytes"):
        rows = []
        for th, text, spans in zip(batch.column("th").to_pylist(), as_bytes(batch.column("bytes")), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            rows.append((th, sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
        yield to_batch(schema, *map(list, zip(*rows)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, period: int = PERIOD) -> DataFrame:
    """Every row's bytes that a ``length``-byte string occurring elsewhere covers.

    docs: ``doc_id, text``; others are ignored. Returns per row ``doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, spans`` (maximal removed runs, in
    bytes). Null and empty texts have no bytes; texts shorter than ``length``
    lose nothing. Equal rows count as occurrences of each other. Texts are named
    by 64-bit hashes (two texts of N share one with a chance of N * N / 2 ** 65).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"))
    bounded(docs)
    keyed = given.filter(F.col("n_bytes") >= length).select("doc_id", "th", F.col("text").cast("binary").alias("bytes"))
    classes = keyed.groupBy("th").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))

    anchors = keyed.select("th", "bytes").mapInArrow(functools.partial(_anchors, length, gram), "anchor long, th long, pos int, loc long")
    twice = anchors.groupBy("anchor").agg(F.min("loc").alias("lo"), F.max("loc").alias("hi")).filter("lo < hi").select("anchor")
    twice = stash(twice, "suffix-anchors")  # a table of its own, so that a hot anchor's side of the join can be split
    places = anchors.select("anchor", "th", "pos").join(twice, "anchor", "left_semi").groupBy("th").agg(F.collect_set("pos").alias("places"))
    wanted = classes.join(places, "th").select("th", "one", "places")
    some = keyed.join(wanted.withColumnRenamed("th", "of"), (keyed["th"] == F.col("of")) & keyed["doc_id"].eqNullSafe(F.col("one"))).select("th", "bytes", "places")
    some = stash(some, "suffix-texts")

    cut = some.mapInArrow(functools.partial(_cut_runs, length, gram), "anchor long, th long, start int, loc long, content long, run binary")
    cut = stash(cut, "suffix-runs")
    distinct = cut.groupBy("anchor", "content").agg((F.min("loc") < F.max("loc")).alias("several"), F.first("run").alias("run"))
    dealt = distinct.repartition("anchor").sortWithinPartitions("anchor")
    repeats = dealt.select("anchor", "content", "several", "run").mapInArrow(functools.partial(_sort_buckets, length, period), "content long, lo int, hi int")
    spans = cut.select("content", "th", "start").join(repeats, "content").select("th", F.struct((F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + (length - 1)).alias("end")).alias("span"))
    spans = spans.groupBy("th").agg(F.collect_set("span").alias("spans"))
    stripped = some.select("th", "bytes").join(spans, "th").mapInArrow(_strip, "th long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>").dropDuplicates(["th"])

    light = given.select("doc_id", "th", "n_bytes", F.sha2("text", 256).alias("sha"))
    out = light.join(classes.select("th", "copies").filter("copies > 1"), "th", "left").join(stripped, "th", "left")
    whole = F.coalesce((F.col("copies") > 1) & (F.col("n_bytes") >= length), F.lit(False))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))).cast("array<struct<start:int,end:int>>")).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
