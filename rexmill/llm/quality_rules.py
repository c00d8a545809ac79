"""Quality rules: learned decision lists over text statistics.

``text_stats`` computes interpretable statistics of whole texts. ``learn``
grows and prunes ordered threshold conjunctions by sequential covering on a
bounded sample of labelled statistics. ``as_column`` emits the list as one
ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, labelled_sample, shingle_hashes, slices, to_batch, word_hashes

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that a list is learned from; the sample is those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
#: Statistics that rules may test.
FEATURES = ("n_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_word_ratio", "upper_ratio", "digit_ratio")
_SYMBOL_TABLE = bytes(set(range(256)) - set(SYMBOLS))
_UPPER_DROP = bytes(set(range(256)) - set(range(65, 91)))
_DIGIT_DROP = bytes(set(range(256)) - set(range(48, 58)))
_CONT = bytes(range(0x80, 0xC0))


def _dup_lines(text: bytes) -> int:
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            dup += line in seen
            seen.add(line)
    return dup


def _repeat_words(words: np.ndarray) -> int:
    """Words inside 5-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n < 6:
        return 0
    h = shingle_hashes(words, 5)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.r_[False, same] | np.r_[same, False]
    cover = np.zeros(n + 1, np.int64)
    at = order[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


_STATS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_upper", "long"), ("n_digits", "long"), ("n_lines", "long")]


def _stats_batches(batches):
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n, _ in _STATS)])
    for batch in slices(batches, "text"):
        texts = [t or b"" for t in as_bytes(batch.column("text"))]
        split = [t.split() for t in texts]
        hashes, at = word_hashes(split)
        rows = []
        for t, w, a, b in zip(texts, split, at, at[1:]):
            joined = b"".join(w)
            lines = t.count(b"\n") + 1
            rows.append((len(w), len(joined.translate(None, _CONT)), len(t.translate(None, _SYMBOL_TABLE)), _dup_lines(t) if lines > 1 else 0, _repeat_words(hashes[a:b]), len(t.translate(None, _UPPER_DROP)), len(t.translate(None, _DIGIT_DROP)), lines))
        yield to_batch(schema, batch.column("doc_id"), *(np.array(c, np.int64) for c in zip(*rows)))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text; a null text has none (zeros)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_stats_batches, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in _STATS))


def with_features(stats: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return stats.withColumns({"mean_word_chars": F.col("word_chars") / words, "symbol_ratio": F.col("n_symbols") / chars, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_word_ratio": F.col("n_repeat_words") / words, "upper_ratio": F.col("n_upper") / chars, "digit_ratio": F.col("n_digits") / chars})


@dataclass(frozen=True)
class Rule:
    """All tests (feature, op, threshold) must hold; op is ``<=`` or ``>``."""

    tests: tuple[tuple[str, str, float], ...]
    bad: int
    good: int

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.tests:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out


def _gain(p0, n0, p, n):
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _best_test(x, y, rows, features):
    p0, n0 = y[rows].sum(), (~y[rows]).sum()
    best = (1e-9, None)
    for name in features:
        v = x[name][rows]
        order = np.argsort(v, kind="stable")
        s, lab = v[order], y[rows][order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        pl, nl = np.cumsum(lab)[cut], np.cumsum(~lab)[cut]
        mid = (s[cut] + s[cut + 1]) / 2
        for op, p, n in (("<=", pl, nl), (">", p0 - pl, n0 - nl)):
            g = _gain(p0, n0, p.astype(float), n.astype(float))
            i = int(np.argmax(g))
            if g[i] > best[0]:
                best = (float(g[i]), (name, op, float(mid[i])))
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, features: tuple[str, ...] = FEATURES, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.8, min_cover: int = 5) -> list[Rule]:
    """Sequential covering of the bad rows: grow on two thirds, prune on one third, remove what is covered."""
    bad = bad.astype(bool)
    alive, rules = np.ones(len(bad), bool), []
    part = np.arange(len(bad)) % 3
    while len(rules) < max_rules and (bad & alive).sum() >= min_cover:
        grow, prune = np.flatnonzero(alive & (part != 2)), np.flatnonzero(alive & (part == 2))
        tests, rows = [], grow
        while len(tests) < max_tests and (~bad[rows]).any() and (t := _best_test(x, bad, rows, features)):
            tests.append(t)
            rows = rows[x[t[0]][rows] <= t[2]] if t[1] == "<=" else rows[x[t[0]][rows] > t[2]]
        if not tests:
            break

        def worth(k):
            m = Rule(tuple(tests[:k]), 0, 0).mask(x)[prune]
            p, n = (bad[prune] & m).sum(), (~bad[prune] & m).sum()
            return (p - n) / max(1, p + n)

        keep = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        m = Rule(tuple(tests[:keep]), 0, 0).mask(x) & alive
        p, n = int((bad & m).sum()), int((~bad & m).sum())
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(tests[:keep]), p, n))
        alive &= ~m
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: true if a document is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        cond = F.lit(True)
        for name, op, t in rule.tests:
            cond = cond & (F.col(name) <= t if op == "<=" else F.col(name) > t)
        out = F.when(cond, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """Learn from at most ``max_labelled`` rows with a label (quality 0 is bad), by the hash of doc_id."""
    lab, sample = labelled_sample(docs, labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lab")), max_labelled)
    featured = with_features(text_stats(sample))
    rows = featured.join(lab, F.col("doc_id") == F.col("lab_id")).select("doc_id", "lab", *FEATURES).orderBy("doc_id", *FEATURES).limit(max_labelled).toPandas()
    if not len(rows):
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["lab"].to_numpy() == 0, **how)


def assess(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> DataFrame:
    """Statistics, base rules and the learned verdict of every document.

    Null, empty and blank texts have zero words and fail the base rules. An
    empty label table learns no rule, and then only the base rules decide.
    """
    rules = fit(docs, labels, max_labelled, **how)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_features(text_stats(docs)).withColumn("base_failed", failed)
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(as_column(rules)))
