"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 harmless, 1 toxic, 2 toxic and of low quality. One weight
per feature is shared by both thresholds: ``P(grade <= j) = sigmoid(theta_j - w.x)``.
Features are words and their beginnings, so that inflected and compounded forms
share what one of them teaches; ``x`` says which of them occur. They are chosen
on a bounded labelled sample by a likelihood-ratio test whose level accounts for
the number of features tried. The cut above which a document is toxic is the one
that does best on the parts of the sample that a model didn't learn from.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, labelled_sample, scratched, slices, stash, to_batch

#: Labelled documents that the model is fitted on.
MAX_LABELLED = 20_000
#: Lengths of the beginnings of words that are features, too.
STEMS = range(3, 8)
#: A feature must occur in so many toxic documents of the sample.
LEAST_TOXIC = 3
#: Parts of the sample that the cut is tried on.
FOLDS = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


@functools.lru_cache(1 << 16)
def _stems(word: str) -> tuple[str, ...]:
    return tuple(f"{word[:k]}-" for k in STEMS if len(word) > k)


def features_of(words) -> set[str]:
    """The words; their beginnings, with a hyphen; and, with two, the beginnings that several of the words have."""
    seen = Counter(chain.from_iterable(map(_stems, words)))
    return {*words, *seen, *(f"{s}-" for s, n in seen.items() if n > 1)}


def chosen_of(words, chosen, known: dict[str, tuple[str, ...]]) -> list[str]:
    """The features of words that are chosen, sorted; known keeps what each word may bring."""
    held: list[str] = []
    for w in words:
        got = known.get(w)
        if got is None:
            got = known[w] = tuple(f for f in (w, *_stems(w)) if f in chosen or f"{f}-" in chosen)
        held += got
    if not held:
        return held
    return sorted(f for f in {*held, *(f"{f}-" for f, n in Counter(held).items() if n > 1)} if f in chosen)


def likelihood_ratio(a: np.ndarray, df: np.ndarray, rate: float) -> np.ndarray:
    """Test statistic of features that a toxic and df documents hold, where a share ``rate`` of all is toxic; 0 if they aren't signs of toxicity."""
    b = df - a
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda seen, expected: np.where(seen > 0, seen * np.log(seen / expected), 0.0)
        return np.where((a >= LEAST_TOXIC) & (a > df * rate), 2 * (part(a, df * rate) + part(b, df * (1 - rate))), 0.0)


def level(tried: int) -> float:
    """The statistic from which on a feature is chosen, of so many that are tried."""
    return 2 * float(np.log(max(2, tried))) + 6


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]  # features
    weights: tuple[float, ...]
    theta: tuple[float, ...]
    cut: float = 0.5  # a document is toxic if P(grade >= 1) is above this

    def predictors(self, texts: list[str | None]) -> np.ndarray:
        """The linear predictor w.x of each text; what a word brings is looked up once."""
        weight = dict(zip(self.words, self.weights))
        known: dict[str, tuple[str, ...]] = {}
        return np.array([sum(weight[f] for f in chosen_of(words_of(t), weight, known)) for t in texts], float)

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade = j) for the linear predictors z, one column per grade."""
        below = 1 / (1 + np.exp(-np.clip(np.asarray(self.theta)[None, :] - z[:, None], -40, 40)))
        return np.diff(np.column_stack([np.zeros(len(z)), below, np.ones(len(z))]), axis=1)

    def p_toxic(self, z: np.ndarray) -> np.ndarray:
        return 1 - self.probabilities(z)[:, 0]


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, n_words: int, n_grades: int = 3, l2: float = 0.3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent (Adam) on the penalised likelihood.

    rows: indexes of the features each document holds. They were chosen as signs
    of toxicity, so weights aren't negative: a common beginning can't take back
    what a word says. Thresholds are kept in order as a first value plus
    exponentials.
    """
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    w, raw = np.zeros(n_words), np.r_[2.0, np.zeros(n_grades - 2)]
    m, v = np.zeros(n_words + len(raw)), np.zeros(n_words + len(raw))
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        theta = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        z = np.bincount(doc, w[word], len(rows))
        up = np.where(grade < n_grades - 1, sig(np.r_[theta, 0][np.minimum(grade, n_grades - 2)] - z), 1.0)
        lo = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - z), 0.0)
        p, dup, dlo = np.maximum(up - lo, 1e-12), up * (1 - up), lo * (1 - lo)
        gz = (dup - dlo) / p
        gt = np.bincount(np.minimum(grade, n_grades - 2), np.where(grade < n_grades - 1, -dup / p, 0), n_grades - 1) + np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dlo / p, 0), n_grades - 1)
        graw = np.r_[gt.sum(), [gt[j:].sum() * np.exp(raw[j]) for j in range(1, len(raw))]]
        g = np.r_[np.bincount(word, gz[doc], n_words) + l2 * w, graw]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = np.maximum(w - move[:n_words], 0.0), raw - move[n_words:]
    return w, np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the highest F1: between the last p that is above and the next one below it."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[:-1] == p[1:]] = 0  # equal p fall on one side
    k = int(np.argmax(f1))
    return float(p[k] / 2 if k + 1 == len(p) else (p[k] + p[k + 1]) / 2)


def cross_fitted(rows: list[np.ndarray], grade: np.ndarray, fold: np.ndarray, n_words: int, tried: int) -> np.ndarray:
    """P(grade >= 1) of each document by a model that is chosen and fitted without its fold."""
    p = np.zeros(len(rows))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    for f in np.unique(fold):
        train = fold != f
        toxic = grade > 0
        if not toxic[train].any() or toxic[train].all():
            p[~train] = toxic[train].mean() if train.any() else 0
            continue
        own = train[doc]
        a, df = np.bincount(word[own & toxic[doc]], minlength=n_words), np.bincount(word[own], minlength=n_words)
        keep = likelihood_ratio(a.astype(float), df.astype(float), float(toxic[train].mean())) >= level(tried)
        at = np.cumsum(keep) - 1
        cut = [at[r[keep[r]]] for r in rows]
        w, theta = fit_ordinal([c for c, t in zip(cut, train) if t], grade[train], int(keep.sum()))
        model = Model((), (), tuple(theta))
        z = np.array([w[c].sum() for c, t in zip(cut, train) if not t])
        p[~train] = model.p_toxic(z)
    return p


@scratched
def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Choose features and fit the model on at most about ``max_labelled`` documents.

    docs: ``doc_id, text``; labels: ``doc_id, quality, toxic``; others are
    ignored. Labels without ``toxic`` or ``doc_id`` are ignored, a null quality
    counts as good; a doc_id labelled twice counts once, with its higher grade.
    Rows repeated with a doc_id each count. Without toxic labels the model has
    no features and finds nothing.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 1, 1).otherwise(2)
    graded = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    lab, sample = labelled_sample(bounded(docs), graded, max_labelled)

    def tokens(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string()))])
        for batch in slices(batches, "text"):
            yield to_batch(schema, batch.column("doc_id"), [sorted(words_of(t)) for t in batch.column("text").to_pylist()])

    token_rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokens, "doc_id long, words array<string>")
    rows = stash(token_rows.join(lab, F.col("doc_id") == F.col("lab_id")).select("doc_id", "grade", "words"), "toxic-sample")
    totals = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    n, toxic = sum(totals.values()), sum(c for g, c in totals.items() if g)
    if not toxic or toxic == n:
        return Model((), (), (30.0, 31.0) if not toxic else (-1.0, 1.0))

    def counted(batches):
        schema = pa.schema([("feature", pa.string()), ("a", pa.int64()), ("df", pa.int64())])
        a, df = Counter(), Counter()

        def out():
            batch = to_batch(schema, list(df), [a[f] for f in df], list(df.values()))
            a.clear(), df.clear()
            return batch

        for batch in batches:
            for g, w in zip(batch.column("grade").to_pylist(), batch.column("words").to_pylist()):
                f = features_of(w)
                df.update(f)
                if g:
                    a.update(f)
                if len(df) > 200_000:
                    yield out()
        if df:
            yield out()

    counts = rows.select("grade", "words").mapInArrow(counted, "feature string, a long, df long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("df").alias("df"))
    counts = stash(counts, "toxic-features")
    tried = counts.count()
    rate, a, b = toxic / n, F.col("a"), F.col("df") - F.col("a")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(a, F.col("df") * rate) + part(b, F.col("df") * (1 - rate)))
    # few by the test's level, as the sample is bounded
    few = counts.filter((a >= LEAST_TOXIC) & (a > F.col("df") * rate) & (ratio >= level(tried))).select("feature")
    chosen = sorted(r["feature"] for r in few.collect())
    if not chosen:
        return Model((), (), (30.0, 31.0))
    at = {w: i for i, w in enumerate(chosen)}

    def held(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("held", pa.list_(pa.int32())), ("tie", pa.int64())])
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            rows = [[at[f] for f in chosen_of(w, at, known)] for w in batch.column("words").to_pylist()]
            yield to_batch(schema, batch.column("doc_id"), batch.column("grade"), rows, [zlib.crc32(str(r).encode()) for r in rows])

    got = rows.select("doc_id", "grade", "words").mapInArrow(held, "doc_id long, grade int, held array<int>, tie long").toArrow().combine_chunks()
    order = np.lexsort([got[c].to_numpy() for c in ("tie", "grade", "doc_id")])
    lists = got["held"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(int)
    index, grades = [flat[ends[i] : ends[i + 1]] for i in order], got["grade"].to_numpy().astype(int)[order]
    fold = np.random.default_rng(7).permutation(len(index)) % FOLDS
    cut = best_cut(cross_fitted(index, grades, fold, len(chosen), tried), grades > 0)
    weights, theta = fit_ordinal(index, grades, len(chosen))
    return Model(tuple(chosen), tuple(float(x) for x in weights), tuple(float(x) for x in theta), cut)


def score(docs: DataFrame, model: Model, cut: float | None = None) -> DataFrame:
    """All columns of docs and ``severity`` (expected grade, 0 to 2), ``p_toxic``, ``toxic`` (p_toxic above the model's cut, or ``cut``).

    Columns of docs with these three names are replaced. Null and empty texts
    hold no words and score the base rate; equal rows score alike.
    """
    cut = model.cut if cut is None else cut
    fields = [f for f in docs.schema.fields if f.name not in ("severity", "p_toxic", "toxic")]
    names = [f.name for f in fields]

    def run(batches):
        for batch in slices(batches, "text"):
            p = model.probabilities(model.predictors(batch.column("text").to_pylist()))
            out = [batch.column(n) for n in names] + [pa.array(p[:, 1] + 2 * p[:, 2]), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] > cut)]
            yield pa.RecordBatch.from_arrays(out, names=names + ["severity", "p_toxic", "toxic"])

    schema = type(docs.schema)(list(fields))
    return bounded(docs).select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema.add("severity", "double").add("p_toxic", "double").add("toxic", "boolean"))
