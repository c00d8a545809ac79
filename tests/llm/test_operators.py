"""Each operator against brute force or a round trip on small tables with nulls, ties and odd columns."""

import base64
import collections
import dataclasses
import gzip
import hashlib
import io
import itertools
import json
import random
import re
import resource
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rexmill.llm import common, decontaminate, language_id, line_dedup, mixing, ngram_join, quality_rules, queries, secret_scan, suffix_dedup, toxicity, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 9223372036854775807


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def vocab():
    return [f"w{i}" for i in range(400)]


@pytest.mark.parametrize("k,num,small", [(3, 90, None), (5, 80, None), (5, 80, 3)])
def test_ngram_components(spark, vocab, monkeypatch, k, num, small):
    rng = random.Random(k)
    if small:  # the buckets are too large, so blocks decide
        monkeypatch.setattr(ngram_join, "SMALL", small)
        monkeypatch.setattr(ngram_join, "BLOCK", 16)
        monkeypatch.setattr(ngram_join, "SKETCH_BLOCK", 32)
    texts = [None, "", "  ", "one", "One", "a b", "A b", "a b c"]
    base = words(rng, 120, vocab).split()
    for i in range(90):  # near copies of one text, more than a small bucket holds
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    for i in range(40):
        t = words(rng, rng.randrange(4, 200), vocab).split()
        texts.append(" ".join(t))
        t[len(t) // 2] = "changed"
        texts.append(" ".join(t))
    for i in range(30):  # much alike, mostly without being linked: hubs don't settle them
        t = list(base)
        for j in rng.sample(range(len(t)), 5):
            t[j] = f"x{i}.{j}"
        texts.append(" ".join(t))
    texts += texts[20:24]
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    docs = frame(spark, texts).withColumn("n", F.lit("x")).withColumn("key", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, k, num, 100).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    kept = {r.doc_id for r in ngram_join.keep_one_of_each(docs, k, num, 100).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


def test_segments():
    """Any two linked sets share a segment."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 10, 11, 40, 150, 900):
        for num in (80, 90):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = (100 - num) * len(x) // 100
            y = np.unique(np.r_[x[most:], rng.integers(0, 1 << 63, max(0, most // 2 - 1)).astype(np.uint64)])
            o = len(np.intersect1d(x, y))
            if 100 * o >= num * (len(x) + len(y) - o) and len(x) != o:
                assert len(np.intersect1d(ngram_join.segment_keys(x, num, 100), ngram_join.segment_keys(y, num, 100))), (n, num)


def test_keep_one_row(spark, vocab):
    x, y, z = (words(random.Random(i), 100, vocab) for i in (1, 2, 3))
    rows = [(3, y), (7, x), (7, y + " end"), (5, z), (5, z), (None, z + " end"), (None, z + " stop"), (None, "a b c d e f"), (None, "a b c d e f"), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1)).withColumn("kept", F.lit(False))
    out = ngram_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(3, y), (7, x), (5, z), (0, "a b c d e f"), (9, ""), (9, "")])
    # near copies without ids: one stays
    null = spark.createDataFrame([(None, x), (None, x + " end")], "doc_id long, text string")
    assert ngram_join.keep_one_of_each(null).count() == 1


def test_ngram_empty(spark):
    assert ngram_join.similar_components(frame(spark, [])).count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_line_dedup(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcé ") for _ in range(r.choice([20, 21, 25, 40]))) for _ in range(12)]

    def change(x):
        k, i = r.randrange(5), r.randrange(len(x) + 1)
        return (x, x[:i] + r.choice("abcé") + x[i:], x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], x[:i] + "zz" + x[i + 2 :])[k]

    rows = [(d, "\n".join(change(r.choice(base)) for _ in range(r.randrange(1, 8)))) for d in range(40)]
    rows += [(100, None), (101, ""), (102, "short\nshort"), (None, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0)).withColumn("h", F.lit(0))
    lines = sorted((d if d is not None else BIG, i, t) for d, text in rows if text is not None for i, t in enumerate(text.split("\n")) if len(t) >= 20)
    first = {}
    for d, i, t in lines:
        first.setdefault(t, (d, i))
    want = {(d, i) for d, i, t in lines if any(p < (d, i) and within_one(m, t) for m, p in first.items())}
    assert {(x.doc, x.no) for x in line_dedup.removals(docs).collect()} == want
    out = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert out[100] is None and out[101] == "" and out[102] == "short\nshort"
    assert out[0] == "\n".join(t for i, t in enumerate(rows[0][1].split("\n")) if (0, i) not in want)
    assert line_dedup.dedup_counts(docs.limit(0)).count() == 0


def test_driver_heap_settles(spark, monkeypatch):
    """A stashed step has a driver whose JVM holds much of its heap's limit collect, and leaves others alone."""
    full = lambda: [x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()][-1]
    for share, more in ((1.0, False), (0.0, True)):
        monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
        before = full()
        common.unstash(common.stash(spark.range(3), "settled"))
        assert (full() > before) == more


def test_short_lines(spark, tmp_path):
    rows = [(1, "menu\n\n- a\nx"), (2, "menu\n\nmena\n- a"), (3, "menu"), (4, " \n \ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, 0), 2: (4, 2, 0), 3: (1, 1, 0), 4: (3, 0, 0)}
    docs = spark.createDataFrame([(*r, "l", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == {1: (rows[0][1], 11), 2: ("\nmena", 5), 4: (rows[3][1], 5)}


def test_line_dedup_query_rebuilds(spark, tmp_path):
    """The query gives each document's rebuilt text as its hash, those of documents that lose every line included."""
    rows = [(1, "the first line of them all\nmenu\n"), (2, "the first line of them alL\n\nmenu\nown"), (3, "menu"), (4, None), (5, "own words\nmenu\nmenu")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.kept_sha256) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    kept = {1: (3, 0, 0, rows[0][1]), 2: (4, 1, 1, "\nown"), 3: (1, 1, 0, ""), 4: (0, 0, 0, ""), 5: (3, 2, 0, "own words")}
    assert got == {i: (*n, hashlib.sha256(text.encode()).hexdigest()) for i, (*n, text) in kept.items()}


def test_line_dedup_shared_ids(spark):
    a, b, c, near = "the first line of them all", "another line that is long", "clean text of a null row", "the first line of them alL"
    rows = [(1, a), (None, f"{a}\n{b}"), (None, c), (None, f"{c}s and more of it"), (7, "one of two texts of id 7"), (7, f"{a}\nthe other text of id 7"), (8, f"{near}\nrest of the document"), (9, "doubled row with this line"), (9, "doubled row with this line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(0)).withColumn("doc", F.lit(0))
    out = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert out == sorted([(1, a), (0, b), (0, c), (0, rows[3][1]), (7, rows[4][1]), (7, "the other text of id 7"), (8, "rest of the document"), *rows[7:]])
    counts = sorted((r.doc_id or 0, r.n_lines, r.n_equal, r.n_near) for r in line_dedup.dedup_counts(docs).collect())
    assert counts == [(0, 1, 0, 0), (0, 1, 0, 0), (0, 2, 1, 0), (1, 1, 0, 0), (7, 1, 0, 0), (7, 2, 1, 0), (8, 2, 0, 1), (9, 1, 0, 0), (9, 1, 0, 0)]
    # rows of one id whose lines have the same numbers: one of two equal or near lines stays
    tied = spark.createDataFrame([(3, f"{a}\n{b}"), (3, f"{near}\n{b}"), (3, f"{a}\n{c}")], "doc_id long, text string")
    left = [t for r in line_dedup.dedup_lines(tied).collect() for t in r.text.split("\n")]
    assert len(left) == 3 and left.count(b) == left.count(c) == 1 and len({a, near} & set(left)) == 1


def test_line_dedup_sizes(spark):
    """A document of many lines is rebuilt in linear time; long lines have near matches like short ones."""
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, "the same line over and over\n" * 60_000 + "end"), (2, "the same line over and over\nnew"), (3, long), (4, long[:9_000] + "#" + long[9_000:]), (5, long[:9_000] + "##" + long[9_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, equal_chars=1).collect()}
    blanks = [x for x in out[1].split("\n") if x]
    assert blanks == ["the same line over and over", "end"] and out[2] == "new"
    # 4 goes as a near match of 3, and 5, two edits from 3, as one of 4
    assert out[3] == long and 4 not in out and 5 not in out


def test_suffix_sort():
    rng = random.Random(3)
    assert {(a - b) % 32 for a in suffix_dedup.difference_cover(32) for b in suffix_dedup.difference_cover(32)} == set(range(32))
    texts = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(4)]
    texts.append(texts[0][:60] + b"q")
    order = suffix_dedup.sort_suffixes(texts, [range(len(t)) for t in texts], 16)
    rest = [texts[i][p:] for i, p in order]
    assert rest == sorted(rest)


def test_suffix_dedup(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefé ") for _ in range(500))
    fill = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    texts = [None, "", "x", fill(300), fill(100) + passage + fill(120), fill(50) + passage[60:430], passage, passage, "a" * 450, passage[:199], fill(250) * 3, "b" * 150 + passage[100:320]]
    texts += [fill(30) + passage[20:280] + fill(400) for _ in range(12)]
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    docs = frame(spark, texts).withColumn("bytes", F.lit(1))
    got = {r.doc_id: r for r in suffix_dedup.repeated_spans(docs).collect()}
    for i, t in enumerate(raw):
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                cover[p] += 1
                cover[p + 200] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def fill(sizes, weights, most=3):
    """Targets by plain rounds."""
    target, full = {}, set()
    total = sum(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in full)
        weight = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / weight for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if target[i] > most * sizes[i]}
        if not more:
            return target
        full |= more


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(600)] + [(1000, None, "a"), (1001, "x y", "z"), (1001, "x y", "z"), (None, "x y z", "z"), (None, "x y z", "z"), (1002, "long " * 5000, "b"), (1003, "", "\U0001F600"), (1004, "q", "\uFFFD")]
    rows += [(2000, "same words here", "a")] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("p", F.lit(1)).withColumn("size", F.lit("s")).withColumn("h", F.lit(0)).withColumn("c", F.lit(9))
    out = mixing.mix(docs, block=50).collect()
    assert len(out) == len(rows) and all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in out)
    assert sorted((str(r.doc_id), r["size"], str(r.source)) for r in out) == sorted((str(d), len((t or "").split()), str(s)) for d, t, s in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in out:
        by[r.source][0] += r["size"]
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = fill([by[s][0] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert np.allclose([by[s][2] for s in order], want)
    for size, taken, target, _ in by.values():
        assert abs(taken - target) <= max(2, 0.002 * target) or size < 20
    # equal rows are taken alike, but for the one that is left to chance
    assert len({r.copies for r in out if r.doc_id == 2000}) <= 2
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.taken) for r in rs)
    assert key(out) == key(mixing.mix(docs.repartition(7), block=50).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(1, "a b c", "s")] * 100 + [(2, "d e", "t")] * 33
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert collections.Counter(r.doc_id for r in out) == {1: 100, 2: 33} and abs(sum(r.taken for r in out) - 366) <= 2


def test_landing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        size, p = rng.integers(1, 30, 8).astype(float), rng.random(8)
        got = mixing.landing(p, size, float(size @ p))
        best = min(abs(size @ np.array(c) - size @ p) for c in itertools.product((0, 1), repeat=8))
        assert set(got) <= {0.0, 1.0} and abs(abs(size @ got - size @ p) - best) < 1e-5
    size, p = rng.integers(1, 500, 300).astype(float), rng.random(300)
    x = np.column_stack([np.ones(300), size])
    q = mixing.flight(p, x)
    assert np.allclose(x.T @ q, x.T @ p) and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2


def test_ranks(spark):
    names = ["b", "a", None, "\U0001F600", "\uFFFD", "", "é", "Z"] + [f"s{i}" for i in range(50)]
    got = {r.source: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert got == {n: i for i, n in enumerate(sorted((n for n in names if n is not None), key=lambda x: [ord(c) for c in x]) + [None])}


def test_language(spark):
    rng = random.Random(4)
    syl = {"xx": ["ka", "lo", "mi"], "yy": ["zu", "pra", "et"], "zz": ["ing", "the", "oun"]}
    rows = [(i, " ".join("".join(rng.choice(syl[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(120) for lang in [rng.choice(list(syl))]]
    docs = spark.createDataFrame(rows + [(500, None, "xx"), (501, "12 !!", None), (502, "kalo", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert out[500].lang_pred == out[501].lang_pred == "und" and out[502].lang_pred == "xx"
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in rows)
    assert {r.lang_pred for r in language_id.identify(docs.filter("lang is null")).collect()} == {"und"}
    empty = docs.limit(0)
    assert language_id.identify(empty).count() == 0
    twice = docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3"))
    assert twice.count() == language_id.identify(twice).count()


def phrases(text, sample):
    """Longest-match parsing of each block by direct search."""
    n = 0
    for at in range(0, len(text), language_id.BLOCK):
        part, i = text[at : at + language_id.BLOCK], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases():
    rng = random.Random(8)
    samples = tuple((str(k), "".join(rng.choice("abcde fgh" + chr(200 + k)) for _ in range(2000))) for k in range(3))
    parser = language_id.Parser(samples)
    texts = ["abcxabd", "", "a", "hello wörld " * 100, samples[1][1][100:900], "é" * 600]
    got = parser.phrases([language_id.symbols(t) for t in texts])
    plain = lambda t: "".join(map(chr, language_id.symbols(t)))
    assert got.tolist() == [[phrases(plain(t), plain(s)) for _, s in samples] for t in texts]


def test_large_alphabets():
    """Automata take memory by their samples, not by states times letters."""
    rng = random.Random(9)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    samples = tuple((str(k), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(30_000))) for k in range(2))
    parser = language_id.Parser(samples)
    assert parser.phrases([language_id.symbols(samples[0][1][:1000])])[0].tolist()[0] == 4
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = [rng.choice(plain) for _ in range(30)] + ([rng.choice(["vile", "nasty"])] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, rng.randrange(2) if toxic else 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(0, None, None), (900, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    assert {"vile", "nasty"} <= set(model.words) <= toxicity.features_of(["vile", "nasty"]) and model.theta[0] < model.theta[1]
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i for i in range(400) if out[i].toxic} == set(range(0, 400, 5)) and not out[900].toxic and not out[901].toxic
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.fit(docs, lab.limit(0))).collect())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), lab)).count() == 0
    twice = toxicity.score(docs.filter("doc_id = 5").union(docs.filter("doc_id = 5")), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].toxic
    # forms that weren't seen share what a beginning teaches
    z = model.predictors(["vilest words of all", "words of all", None, "a " * 100_000 + "nasty"])
    assert z[0] > z[1] == z[2] < z[3]


def test_ordinal_fit():
    """The fit is near the optimum that plain gradient steps find."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(5) < 0.3) for _ in range(300)]
    true = np.array([2.0, 1.0, 0.5, 0.0, 1.5])
    z = np.array([true[r].sum() for r in rows]) + rng.logistic(size=300)
    grade = (z > 1.5).astype(int) + (z > 3)

    def loss(w, theta, l2=0.3):
        m = toxicity.Model((), (), tuple(theta))
        p = m.probabilities(np.array([w[r].sum() for r in rows]))
        return -np.log(p[np.arange(300), grade]).sum() + l2 * (w**2).sum() / 2

    w, theta = toxicity.fit_ordinal(rows, grade, 5, l2=0.3)
    best = loss(w, theta)
    assert theta[0] < theta[1] and (w >= 0).all()
    for _ in range(300):  # no point near it is better
        assert loss(np.maximum(w + rng.normal(0, 0.1, 5), 0), theta + rng.normal(0, 0.1, 2)) > best - 0.05


def test_cut():
    p, toxic = np.array([0.9, 0.8, 0.3, 0.2, 0.2, 0.1]), np.array([1, 1, 1, 0, 0, 0], bool)
    assert toxicity.best_cut(p, toxic) == 0.25
    assert toxicity.best_cut(p[:1], toxic[:1]) == 0.45


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [f"w{rng.randrange(500)}" + ("%%%" if bad else "") for _ in range(40)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    odd = [(900, None), (901, "a b"), (902, "x y z u v " * 6), (903, "one two\none two\n\n")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("kept", F.lit(0)).withColumn("lab", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.assess(docs, lab).collect()}
    assert {i for i in range(300) if out[i].kept} == {i for i in range(300) if i % 4}
    assert out[900].n_words == 0 and out[900].base_failed and out[901].base_failed and not out[902].kept
    assert (out[902].n_words, out[902].n_repeat_words, out[903].n_dup_lines) == (30, 30, 1)
    for i, t in rows[:20]:
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols) == (40, len(t) - 39, t.count("%"))


def test_secrets(spark):
    texts = [None, "", 'é password: "abcdefghij12", token=short AKIA' + "A1" * 9 + " x", "deadbeefdeadbeef0 api_key=deadbeefdeadbeefff", "-----BEGIN RSA PRIVATE KEY-----", 'token=secret: abcdefghijklmnop']
    docs = frame(spark, texts + texts[2:3]).withColumn("blob", F.lit(1)).withColumn("spans", F.lit(1))
    found = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan_paths(docs.select("doc_id", "text"))[0]).collect()}
    for i, t in enumerate(texts + texts[2:3]):
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.pattern, t or ""):
                if len(m[rule.group]) >= rule.least:
                    want.append((m.start(), k, m.end()))
        assert found[i].spans == ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(want))
        base = ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(want) if secret_scan.RULES[k].base)
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert secret_scan.digest(secret_scan.scan_paths(docs.select("doc_id", "text").limit(0))[0]).count() == 0


def test_ledger(spark):
    first = spark.createDataFrame([("a", 1, "deadbeefdeadbeef"), ("b", 1, "nothing"), ("c", 1, None)], "path string, v int, text string")
    found, ledger = secret_scan.scan_paths(first)
    assert ledger.count() == 3 and all(len(r.scans) == len(secret_scan.RULES) for r in ledger.collect())
    # a second version of the history: only the new blob is scanned, old findings reach new paths
    second = first.unionByName(spark.createDataFrame([("a", 2, "AKIA" + "Z" * 16), ("d", 2, "deadbeefdeadbeef"), ("b", 2, "nothing")], first.schema))
    new = secret_scan.update_ledger(second, ledger)
    assert [len(r.spans) for r in new.collect()] == [1]
    found, ledger = secret_scan.scan_paths(second, ledger)
    spans = {(r.path, r.v): [(s.start, secret_scan.RULES[s.rule].kind, s.end) for s in r.spans] for r in found.collect()}
    assert spans == {("a", 1): [(0, "hex", 16)], ("b", 1): [], ("c", 1): [], ("a", 2): [(0, "access", 20)], ("d", 2): [(0, "hex", 16)], ("b", 2): []}
    assert ledger.count() == 4 and secret_scan.update_ledger(second, ledger).count() == 0
    # one rule bumped: the plan holds that rule only, and its findings replace the old version's
    bumped = tuple(dataclasses.replace(r, version=2, pattern="[0-9a-z]{7,}", least=7) if r.kind == "hex" else r for r in secret_scan.RULES)
    again = secret_scan.update_ledger(second, ledger, bumped)
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert "[0-9a-z]{7,}" in plan and "AKIA" not in plan and "eyJ" not in plan
    assert sorted(len(r.spans) for r in again.collect()) == [0, 0, 1, 1] and all(r.scans == [("hex", 2)] for r in again.collect())
    found, ledger = secret_scan.scan_paths(second, ledger, bumped)
    spans = {(r.path, r.v): [(s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans["b", 2] == spans["b", 1] == [(0, 7)] and spans["a", 1] == [(0, 16)] and spans["a", 2] == [(0, 20)]


def test_decontamination(spark):
    items = ["A train leaves town at 40 km and the rider Bob pays 40 dollars for the long trip home today", "tiny item", "the quick brown fox jumps over the lazy dog near the old mill by the river bank"]
    docs = [
        "intro words. a train leaves town at 75 km and the rider Ann pays 75 dollars for the long trip home today and more",
        "intro words. a train leaves town at 75 km and the rider Ann pays 31 dollars for the long trip home today and more",
        "nothing here to see but plain words that go on for a while", None, "", "so a tiny item it is", "xx " + items[2].upper() + " yy", "the quick brown fox jumps over something else entirely different from before",
    ]
    d = frame(spark, docs).withColumn("pos", F.lit(0))
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(7, None), (8, "")], "item_id long, text string").withColumn("h", F.lit(0))
    got = {r.doc_id: list(r["items"]) for r in decontaminate.tag_contaminated(d, b).collect() if r.contaminated}
    assert got == {0: [0], 5: [1], 6: [2]}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()) == [1, 2, 3, 4, 7]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


def test_decontamination_copies(spark):
    item = "A train leaves town at 40 km and the rider Bob pays 40 dollars for the long trip home today while his brother waits at the old station near the river"
    docs = [
        item.replace("and the", "and so the").replace("40", "75"),  # a word more between two places of one value
        item.lower(), item.upper(), item.replace(" ", "\n"), "so " + item.replace("rider Bob", "rider\nBob") + " ok",
        item.replace("40 km", "75 km").replace("and the", "and so the"),  # values that disagree, but 20 words of the item's own
    ]
    b = spark.createDataFrame([(0, item), (1, "Ask Ann and Bob"), (2, "so it was said by Carl")], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.tag_contaminated(frame(spark, docs + ["well ask ann and\nBOB then"]), b).collect() if r.contaminated}
    assert got == {0: [0], 1: [0], 2: [0], 3: [0], 4: [0], 5: [0], 6: [1]}


def test_decontamination_rows(spark):
    """Rows without an id and rows that share one are judged by their own texts; the second of two occurrences counts."""
    item = "A train leaves town at 40 km and the rider Bob pays 40 dollars for the long trip home today"
    twisted = item.replace("40 km", "75 km").replace("40 dollars", "31 dollars")
    rows = [(None, item), (None, "clean text without an id"), (7, item), (7, "clean text of id seven"), (8, item), (8, item), (9, f"{twisted}. And then: {item}"), (10, twisted), (11, "word " * 50_000 + item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("items", F.lit(0)).withColumn("n_items", F.lit(0))
    b = spark.createDataFrame([(0, item), (0, item), (None, "clean text of id seven")], "item_id long, text string")
    out = decontaminate.tag_contaminated(d, b).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in out) == [(0, False), (0, True), (7, False), (7, True), (8, True), (8, True), (9, True), (10, False), (11, True)]
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, rows[1][1]), (7, rows[3][1]), (10, twisted)])
    assert decontaminate.tag_contaminated(d, b.limit(0)).filter("contaminated").count() == 0


def test_decontamination_parts(spark):
    """A long part of an item counts, a short one and one with other values don't."""
    item = "A train leaves town at 40 km an hour and the rider Bob pays 40 dollars for the long trip home today while his brother waits at the old station near the river bank with two bags and a small dog that barks at every stranger who walks past the gate in the evening light of a cold winter day"
    w = item.split()
    rows = [" ".join(["x"] * 3 + w[a:b] + ["y"] * 3) for a, b in ((20, 33), (20, 32), (0, 25), (30, len(w)))] + [" ".join(w[:22]).replace("40", "75"), " ".join(w[20:28] + ["z"] + w[28:36])]
    b = spark.createDataFrame([(4, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.tag_contaminated(frame(spark, rows), b).collect() if r.contaminated}
    assert got == {0, 2, 3}


def test_decontamination_windows(spark):
    """Items without slots: found where 0.8 of their distinct windows are, or 13 words in a row, by brute force."""
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in "bdfgklm" for b in ("ab", "en", "ir", "ol")]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    docs = []
    for _ in range(60):
        t = [rng.choice(vocab) for _ in range(20)]
        for _ in range(2):
            copy = list(rng.choice(items))
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            t += copy + [rng.choice(vocab)]
        docs.append(t)
    windows = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    want = {i: sorted(k for k, item in enumerate(items) if len(windows(item, n := min(5, len(item))) & windows(t, n)) >= 0.8 * len(windows(item, n)) or windows(item, 13) & windows(t, 13)) for i, t in enumerate(docs)}
    got = decontaminate.tag_contaminated(frame(spark, [" ".join(t) for t in docs]), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert {r.doc_id: list(r["items"]) for r in got} == want


def test_warc(spark, monkeypatch):
    big = "<html>" + "é" * 80
    rows = [(3, "http://a/1", big), (1, "http://a/2\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(0)).withColumn("kind", F.lit(0))
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 500)
    out = {r.page_id: r for r in warc.read_packages(warc.write_packages(pages)).collect()}
    assert len(out) == len(rows)
    for page, _, html in rows:
        raw, r = (html or "").encode(), out[page]
        again = html == big and page != 1
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None)
        assert r.payload == (None if again else raw)
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_zip64(monkeypatch):
    records = [warc._gzip(warc.record_bytes(i, "u", b"x" * i, "d", i, "response", None)) for i in range(5)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = warc.package(records, [{"page": i} for i in range(5)])
    assert b"PK\x06\x06" in data
    f = pa.BufferReader(data)
    ranges = warc.record_ranges(f, len(data), 1)
    assert len(ranges) == 5
    blocks = [b for at, n, _ in ranges for _, b in warc.parse_records([f.read_at(n, at)])]
    assert [len(b.partition(b"\r\n\r\n")[2]) for b in blocks] == list(range(5))
    with pytest.raises(ValueError):
        warc.central_directory(pa.BufferReader(b"no zip"), 6)
    assert io.BytesIO(data).read(4) == b"PK\x03\x04"


def foreign(kind, rid, block, *extra):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID:{rid}", "a line of no use", "WARC-Date: 2024-01-01T00:00:00Z", *extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


BODY = b"<p>hello</p>" * 50
RECORDS = [
    foreign("warcinfo", "<urn:uuid:0>", b"software: x\r\n"),
    foreign("response", "<urn:uuid:1>", b"HTTP/1.1 200 OK\r\nServer: x\r\n folded\r\nTransfer-Encoding: chunked\r\n\r\n%x;a=b\r\n" % len(BODY) + BODY + b"\r\n0\r\n\r\n", "WARC-Target-URI: http://a"),
    foreign("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n"),
    foreign("response", "<urn:uuid:3>", b"HTTP/1.1 200 OK\r\n\r\nplain", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(b'plain').digest()).decode()}"),
    foreign("revisit", "<urn:uuid:4>", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: sha1:ABC"),
    foreign("resource", "<urn:uuid:5>", b"raw bytes"),
]


@pytest.mark.parametrize("step", [1, 7, 1000, 1 << 30])
def test_record_streams(step):
    for data in (b"".join(RECORDS), b"".join(map(gzip.compress, RECORDS)), gzip.compress(b"".join(RECORDS))):
        rows = [warc.page_of(h, b) for h, b in warc.parse_records(data[i : i + step] for i in range(0, len(data), step))]
        assert [r and r[4] for r in rows] == [None, "response", None, "response", "revisit", "resource"]
        assert rows[1][1:4] == ("http://a", len(BODY), hashlib.sha256(BODY).hexdigest()) and rows[1][6] == BODY
        assert rows[3][6] == b"plain" and rows[5][6] == b"raw bytes" and rows[4][8] == "<urn:uuid:1>"
    with pytest.raises(ValueError):
        list(warc.parse_records([RECORDS[1][:-30]]))
    with pytest.raises(ValueError):
        warc.page_of(*next(warc.parse_records([RECORDS[3].replace(b"plain", b"plaim")])))


def test_foreign_packages(spark, tmp_path):
    """Packages of other writers: compressed or missing indexes, deflated members."""
    members, lines, at = [gzip.compress(r) for r in RECORDS], [], 0
    for m in members:
        lines.append("com,a)/ 2024 " + json.dumps({"filename": "archive/d.warc.gz", "offset": str(at), "length": str(len(m))}))
        at += len(m)
    paths = []
    for mode in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        for index in ("indexes/index.cdx.gz", "indexes/index.cdxj", None):
            paths.append((str(tmp_path / f"{len(paths)}.wacz"),))
            with zipfile.ZipFile(paths[-1][0], "w", mode) as z:
                z.writestr("archive/d.warc.gz", b"".join(members))
                z.writestr("archive/", b"")
                text = "\n".join(lines).encode()
                if index:
                    z.writestr(index, gzip.compress(text) if index.endswith("gz") else text)
    out = warc.read_packages(spark.createDataFrame(paths, "path string")).collect()
    assert collections.Counter(r.record_id for r in out) == {f"<urn:uuid:{i}>": 6 for i in (1, 3, 4, 5)}
    assert all(r.page_id is None and r.refers_to is None for r in out) and {r.payload_bytes for r in out if r.record_type == "response"} == {600, 5}


def test_memory_of_long_texts():
    """Anchors of one long text are found piece by piece."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 9 << 20, dtype=np.uint8).tobytes()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    i, start, count, pos, a = suffix_dedup.runs([text])
    assert int(count.sum()) == len(text) - 199 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400 << 10


def test_shared_folder(spark):
    folder = common.shared_dir(spark)
    assert folder
    with common.scratch():
        gone = common.stash(spark.range(3).toDF("a"), "t")
        kept = common.stash(spark.range(3).toDF("a"), "t", keep=True)
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone._stash_path)


def test_pipeline(spark, tmp_path):
    """Each stage's decisions take effect on rows with and without ids, shared ids and repeated rows; clean ones stay."""
    rng = random.Random(20)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "sk", "lm")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = "A train leaves town at 40 km and the rider Bob pays 40 dollars for the long trip home today"
    clean = [(i, line(30) + "\n" + line(25)) for i in range(40)]
    copy = line(200)
    near = [copy.replace(" ", " x ", 1), " ".join(w if i % 70 else "other" for i, w in enumerate(copy.split()))]
    doubled, menu = line(40), "the same menu line in many documents"
    rows = clean + [(100 + i, line(20) + " vile " + line(5) + " nasty") for i in range(12)] + [(None, line(20) + " vile nasty thing"), (None, line(30))]
    rows += [(200, copy), (201, near[0]), (None, near[1]), (300, f"{line(10)} {item} {line(10)}"), (None, f"{item.replace('40', '75')} {line(12)}"), (301, line(33)), (301, line(34)), (302, doubled), (302, doubled)]
    rows += [(400 + i, f"{menu}\n{line(20)}") for i in range(5)] + [(410, menu), (500, None), (501, ""), (502, " \n ")]
    docs = spark.createDataFrame([(d, t, "en", rng.choice(["a", "b", None]), len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("th", F.lit(1)).withColumn("row", F.lit("r")).withColumn("toxic", F.lit(True)).withColumn("h", F.lit(0)).withColumn("size", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = collections.Counter(r.doc_id for r in out)
    # of the documents without id the clean one and none of the toxic, copied and contaminated ones stay
    want = collections.Counter([*range(40), None, 200, 301, 301, 302, *range(400, 405), 500, 501, 502])
    assert got == want
    sizes = {r.doc_id: r["size"] for r in out}
    assert sizes[400] == 27 and sizes[401] == 20 and sizes[500] == 0 and sizes[200] == 200
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in out:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken - target) <= 40 for taken, target in by.values())  # whole copies of some 55 words


def test_pipeline_empty(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_counts(spark):
    """The base statistics against plain counting, on texts of any kind."""
    rng = random.Random(13)
    vocab = ["a", "b", "c", "é#", "<x>", "%"]
    texts = [None, "", " \n\t ", "x " * 30_000]
    texts += ["".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\n\n", "\t", "\u00a0"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = frame(spark, texts + texts[10:12]).withColumn("n_words", F.lit(0)).withColumn("words", F.lit(0))
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(64)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.assess(docs, lab).collect()}
    assert len(out) == len(texts) + 2
    for i, t in enumerate(texts + texts[10:12]):
        w = WORDS.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = set()
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                again |= set(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        assert not (r.base_failed and r.kept)
    assert quality_rules.assess(docs.limit(0), lab).count() == 0 and quality_rules.assess(docs.limit(3), lab.limit(0)).count() == 3
