"""Language ID by cross-parsing entropy.

A suffix automaton per language is built from a bounded sample of labelled
text. A text is parsed greedily into longest phrases that the automaton holds
(the Ziv-Merhav cross-parsing); the language that needs the fewest phrases per
symbol wins. Symbols are letters, lower-cased, and one blank for each run of
other characters. Texts are parsed in blocks of ``BLOCK`` symbols, so that many
blocks step through the automata together; a block begins a new phrase for
every language alike. The automata are one hash table of their transitions, so
memory goes with the sample, not with states times letters.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratched, slices, stash, to_batch

#: Symbols of labelled text that an automaton is built from.
SAMPLE_SYMBOLS = 30_000
#: Labelled documents per language that the sample may be drawn from.
SAMPLE_DOCS = 200
#: Symbols of all samples together; with more languages than share them each has fewer, but LEAST_SYMBOLS.
ALL_SYMBOLS, LEAST_SYMBOLS = 6_000_000, 200
BLOCK = 256
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def symbols(text: str | None) -> np.ndarray:
    """Code points of a text: letters lower-cased, each run of others as one blank."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    cp = np.where(letter, cp, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return cp[keep]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of seq."""
    link, length, nxt, last = [-1], [0], [{}], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Table:
    """An automaton's transitions in an open-addressing hash table; state 0 is the root."""

    def __init__(self, auto: list[dict[int, int]], width: int):
        keys = np.fromiter((c for moves in auto for c in moves), np.int64) + np.repeat(np.arange(len(auto)), [len(m) for m in auto]) * width
        to = np.fromiter((x for moves in auto for x in moves.values()), np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.width, self.shift, self.mask = width, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after symbols c, or -1."""
        key = state * self.width + c
        slot = self._slot(key)
        there = self.keys[slot]
        out = self.to[slot].astype(np.int64)
        miss = np.flatnonzero(there != key)
        while len(miss):
            open_ = there[miss] != -1
            out[miss[~open_]] = -1
            miss = miss[open_]
            slot[miss] = at = (slot[miss] + 1) & self.mask
            there[miss] = found = self.keys[at]
            hit = found == key[miss]
            out[miss[hit]] = self.to[at[hit]]
            miss = miss[~hit]
        return out


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        seqs = [symbols(text) for _, text in samples]
        seen = np.unique(np.concatenate([*seqs, np.array([32], np.uint32)]))
        self.code = np.zeros(0x110000, np.int32)  # 0: in no sample
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.tables, self.dead = [], []
        for seq in seqs:
            auto = suffix_automaton(self.code[seq].tolist())
            self.tables.append(Table(auto, len(seen) + 1))
            self.dead.append(len(auto))  # after a symbol that a language lacks: a phrase of its own, with no way on

    def phrases(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Phrases that each sequence needs, one column per language."""
        lens = np.array([len(s) for s in seqs], np.int64)
        blocks = -(-lens // BLOCK)
        total = int(blocks.sum())
        grid = np.full((total, BLOCK), -1, np.int32)  # -1: after a block's end
        flat = grid.ravel()
        start = np.r_[0, np.cumsum(blocks)[:-1]] * BLOCK
        for s, at in zip(seqs, start):
            flat[at : at + len(s)] = self.code[s]
        # the longest blocks first, so that those that have ended are cut off
        sizes = (grid >= 0).sum(axis=1)
        order = np.argsort(-sizes, kind="stable")
        steps, left = np.ascontiguousarray(grid[order].T), np.searchsorted(-sizes[order], -np.arange(BLOCK), side="left")
        owner = np.repeat(np.arange(len(seqs)), blocks)[order]
        counts = []
        for table, dead in zip(self.tables, self.dead):
            state, count = np.full(total, dead, np.int64), np.zeros(total, np.int64)
            for column, n in zip(steps, left):
                if not n:
                    break
                c = column[:n].astype(np.int64)
                to = table.step(state[:n], c)
                fail = np.flatnonzero(to < 0)
                if len(fail):
                    count[fail] += 1
                    again = table.step(np.zeros(len(fail), np.int64), c[fail])
                    to[fail] = np.where(again < 0, dead, again)
                state[:n] = to
            counts.append(np.bincount(owner, count, len(seqs)))
        return np.column_stack(counts) if counts else np.zeros((len(seqs), 0))


@functools.lru_cache(2)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


@scratched
def fit(labelled: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS, sample_docs: int = SAMPLE_DOCS, all_symbols: int = ALL_SYMBOLS) -> tuple[tuple[str, str], ...]:
    """Sample text of each language: documents by the hash of doc_id, up to ``sample_symbols`` symbols.

    labelled: ``doc_id, text, lang``; null texts and langs are ignored. With n
    languages a sample has all_symbols / n symbols at most.
    """
    rows = bounded(labelled).filter("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = stash(rows.groupBy(F.col("lang").alias("of")).count(), "language-counts")
    n = counts.count()
    sample_symbols = max(min(sample_symbols, all_symbols // max(n, 1)), LEAST_SYMBOLS)
    part = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("count"))
    limits = counts.select("of", (share * (1 << 30)).cast("long").alias("limit"))
    # of each document the sample takes no more than a language needs
    got = rows.join(limits, rows["lang"] == limits["of"]).filter(part < F.col("limit")).select("lang", F.substring("text", 1, sample_symbols).alias("text"), part.alias("h"), "doc_id")
    got = got.groupBy("lang", F.pmod("h", F.lit(8)).alias("b")).applyInPandas(functools.partial(_shorten, sample_symbols), "lang string, text string, h long").toPandas()
    out = []
    for lang, own in got.sort_values(["lang", "h", "text"]).groupby("lang"):
        text, size = [], 0
        for t in own["text"]:
            s = symbols(t)[: sample_symbols - size]
            text.append("".join(map(chr, s)))
            size += len(s)
            if size >= sample_symbols:
                break
        if size:
            out.append((lang, " ".join(text)))
    return tuple(sorted(out))


def _shorten(most: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """The first documents of a language's eighth by hash, until ``most`` characters are passed."""
    pdf = pdf.sort_values(["h", "text"])
    size = pdf["text"].str.len().cumsum().shift(fill_value=0)
    return pdf[size < most][["lang", "text", "h"]]


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    score: 1 - phrases of the best language / phrases of the second. ``und``
    with score 0 if the text is null or has no letter, or nothing was learned;
    equal counts go to the language first by code point.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        parser = parser_of(samples) if samples else None
        for batch in slices(batches, "text", 1 << 20):
            seqs = [symbols(t) for t in batch.column("text").to_pylist()]
            n = parser.phrases(seqs) if parser else np.zeros((len(seqs), 0))
            lang, score = [], []
            for s, row in zip(seqs, n):
                if not len(s) or not len(row):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                order = np.argsort(row, kind="stable")
                lang.append(parser.langs[order[0]])
                score.append(float(1 - row[order[0]] / row[order[1]]) if len(row) > 1 else 1.0)
            yield to_batch(schema, batch.column("doc_id"), lang, score)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS) -> DataFrame:
    """Learn from rows that aren't held out, predict all. A null doc_id is learned from."""
    samples = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"), sample_symbols)
    return predict(docs, samples).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
