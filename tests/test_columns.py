"""Column functions: both tiers agree, planning, SQL functions, streams."""

import pytest
from pyspark.sql import functions as F

from rexmill.functions import columns as rx
from rexmill.functions import sql
from rexmill.functions.sql import register
from rexmill.operators import api
from rexmill.operators.api import regex
from rexmill.plans.planner import plan
from rexmill.queries import QUERIES
from rexmill.sources.tables import tag_by_patterns
from rexmill.streaming.stateless import windowed_hits

TEXTS = ["", "abc 12 ab", "É straße\r\nx", "a,b;;c", "foo(bar(baz))", "x" * 3000, "token = \"ff00\" é😀x1", "Aa aA KkKK", "a\nb\n", None]
NATIVE = [r"\d+", r"\bab?\b", r"[a-c&&b-z]+", "a|b;", r"(\w)\1", "^b$", r"(?<=a)b", r"(?>a|ab)c", r"\R", "(?i)k+", r"[[:punct:]]", r"\s+", r"(a)?(?(1)b|c)", r"x{2,5}", r"\p{Lu}\p{Ll}", r'"([^"\\]|\\.)*"', r"\((?:[^()]|\(\))*\)", r"(?:a|[^ab])+b", "(?(?=a)ab)c", "(?(a)b|c)", r"(?~b)c", r"b\Z",
          "(?i)[a-z]+", "(?i)[^a-z]+", r"(?i)\p{Lu}+", "(?I)[a-k]+", "(?i)stress", "(?i)ss|ß", "(?i)office", "(?i)(?:ff|f)i", "(?i)[ß-ü]", "(?i)k{2}",
          "(?:ab)*", "(?:ab|cd;)+", "(?:[a-z]+;)+[A-Z]", r"(?:,|[a-z]+\()*\)", r"(?:[a-z]{2}[.;])*[A-Z]+", r"(a[^;,]*[;,])+$",
          r"(?<n>\d)\g<n>", r"(?<w>[a-z]{1,9})[.;]\g<w>", r"a\Kb", r";\K[a-zA-Z]+", "(?:x(*MAX{3}))*y", "(?:x(*MAX{3}))*", r"\G[a-z]", r"\p{InLatin_Extended-A}|\p{InNumberForms}|b"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")


@pytest.mark.parametrize("pattern", NATIVE)
def test_tiers_agree(df, pattern):
    assert plan(regex(pattern), "find").tier == "native"
    out = df.select(
        *[rx.matches("t", pattern, tier=k).alias(f"m{k}") for k in ("", "kernel")],
        *[rx.find("t", pattern, tier=k).alias(f"f{k}") for k in ("", "kernel")],
        *[rx.find_span("t", pattern, tier=k).alias(f"s{k}") for k in ("", "kernel")],
        *[rx.find_all("t", pattern, tier=k).alias(f"a{k}") for k in ("", "kernel")],
        *[rx.count("t", pattern, tier=k).alias(f"c{k}") for k in ("", "kernel")],
        *[rx.replace("t", pattern, "<$0>", tier=k).alias(f"r{k}") for k in ("", "kernel")],
        *[rx.split("t", pattern, tier=k).alias(f"p{k}") for k in ("", "kernel")],
        *[rx.find_backward("t", pattern, tier=k).alias(f"b{k}") for k in ("", "kernel")],
        *[rx.find_struct("t", pattern, tier=k).alias(f"x{k}") for k in ("", "kernel")],
        *[rx.match_at("t", pattern, tier=k).alias(f"z{k}") for k in ("", "kernel")],
        *[rx.starts_with("t", pattern, tier=k).alias(f"y{k}") for k in ("", "kernel")],
        *[rx.find_all_spans("t", pattern, tier=k).alias(f"w{k}") for k in ("", "kernel")],
        *[rx.replace("t", pattern, "[$0]$$", count=2, tier=k).alias(f"n{k}") for k in ("", "kernel")],
        *[rx.split("t", pattern, 1, tier=k).alias(f"q{k}") for k in ("", "kernel")],
    ).collect()
    for row in out:
        for k in "mfsacrpbxzynqw":
            assert row[k] == row[f"{k}kernel"], (pattern, k, row)


@pytest.mark.parametrize("pattern", ["(a)?(b)", "(a)|(b)", "(a*)(;)?", r"\A(?:(\w+):)?(\w*)(.)?", "(?:(a)|(b)|(x))+", r"(?<k>\w)(?<v>\d)?", "(?i)(s)(t)?|(f+)"])
def test_optional_groups(df, pattern):
    """Unset groups and empty ones are told apart in both tiers."""
    n = regex(pattern).capture_count
    cols = [rx.extract("t", pattern, i, tier=k).alias(f"g{i}{k}") for i in range(n + 1) for k in ("", "kernel")]
    cols += [rx.extract_struct("t", pattern, tier=k).alias(f"s{k}") for k in ("", "kernel")]
    assert "ArrowEval" not in df.select(*cols[::2])._jdf.queryExecution().executedPlan().toString()
    cols += [rx.replace("t", pattern, "<$1>", 1, tier=k).alias(f"r{k}") for k in ("", "kernel")]
    for row in df.select(*cols).collect():
        for k in [*(f"g{i}" for i in range(n + 1)), "s", "r"]:
            assert row[k] == row[f"{k}kernel"], (pattern, k, row)


@pytest.mark.parametrize("pattern", ["(?i)[a-z]", "(?i)[k-s]", "(?i)[à-ÿ]", "(?i)[^a-z]", r"(?i)\p{Lu}", r"(?i)\p{Ll}", "(?I)[a-z]", "(?i)[α-ω]", "(?i)s", "(?i)[[:upper:]]", r"(?i)[\x{1E00}-\x{1EFF}&&\p{L}]"])
def test_caseless_sets_exactly(spark, pattern):
    """Every code point that Java knows is in a caseless set in both tiers or in neither."""
    import unicodedata

    chars = [chr(c) for c in range(0x1F000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    assert plan(regex(pattern), "find").tier == "native"
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", rx.matches("c", pattern + r"\z").alias("n"))
    got = {r.c for r in rows.collect() if r.n}
    want = {c for c in chars if api.match_at(regex(pattern + r"\z"), c, 0)}
    assert not {c for c in got ^ want if "\\p" not in pattern and "[:" not in pattern}, pattern
    assert len(got ^ want) < 700  # letters of later versions of Unicode


def test_many_spans(spark):
    text = "aé, " * 30_000
    row = spark.createDataFrame([(text,)], "t string").select(rx.find_all_spans("t", r"\w+").alias("s")).select(F.size("s").alias("n"), F.element_at("s", 17)[0].alias("x"), F.element_at("s", -1)[0].alias("y")).first()
    assert (row.n, tuple(row.x), tuple(row.y)) == (30_000, (80, 83), (149_995, 149_998))


def test_linear_in_the_subject(spark):
    """Loops over groups that run natively take neither stack nor more than linear time."""
    text = "ab." * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(F.length(rx.find("t", r"(?:[a-z]+\.)*\z")).alias("n"), F.length(rx.find("t", r"(?:ab\.)*")).alias("k"), F.length(rx.find("t", "(?i)[a-z.]+")).alias("c")).first()
    assert tuple(row) == (len(text),) * 3
    assert len(api.find_all_text(regex(r"é|\X"), "é" * 20_000)) == 20_000


def test_long_loop_is_safe(spark):
    """A loop over a group that runs native takes no stack for its rounds."""
    text = '"' + 'a\\\\\\"' * 200_000 + '"'
    row = spark.createDataFrame([(text,)], "t string").select(F.length(rx.find("t", r'"([^"\\]|\\.)*"')).alias("n"), rx.count("t", r'"([^"\\]|\\.)*"').alias("c")).first()
    assert tuple(row) == (len(text), 1)


def test_planner():
    for pattern in ("(a|ab)*d", "(a+)+b", r"\X", r"(?L)a", r"\g<0>?a", r"(?:[a-z0-9]+\.)+[a-z]{2,}", r"(?y{w})."):
        try:
            assert plan(regex(pattern), "find").tier == "kernel", pattern
        except ValueError:
            pass
    assert plan(regex("(a|bc)*d"), "find").tier == "native"
    assert plan(regex("a*"), "find").tier == "native" and plan(regex("a*"), "find_all").tier == "kernel"
    assert plan(regex("foo.+bar+"), "matches").required == "foo"


def test_structs(df):
    row = df.where("id = 3").select(rx.find_struct("t", "(z)?,(b)").alias("m")).select(rx.match_span(F.col("m")).alias("s"), rx.captured(F.col("m"), 0).alias("c0"), rx.captured(F.col("m"), 1).alias("c1"), rx.group_count(F.col("m")).alias("n"), rx.span_text(rx.capture_span(F.col("m"), 1)).alias("t")).first()
    assert (tuple(row.s), row.c0, row.c1, row.n, row.t) == ((1, 3), False, True, 2, "2 .. 3")
    named = df.where("id = 3").select(rx.find_struct("t", "(?<y>z)?,(?<x>b)").alias("m"), "t").select(*[f for g in ("x", "y", "none") for f in (rx.captured(F.col("m"), g, "(?<y>z)?,(?<x>b)"), rx.capture_text("t", F.col("m"), g, "(?<y>z)?,(?<x>b)"))]).first()
    assert tuple(named) == (True, "b", False, None, False, None)
    got = [r[0] for r in df.orderBy("id").select(rx.extract("t", "(z)|a", 1)).collect()]
    assert all(g is None for g in got)
    with pytest.raises(ValueError):
        rx.matches("t", "(")


def test_sql_and_table_function(spark, df):
    register(spark)
    df.createOrReplaceTempView("rx_texts")
    assert spark.sql(r"SELECT rx_count(t, 'a') FROM rx_texts WHERE id = 1").first()[0] == 2
    rows = spark.sql(r"SELECT f.match_no, f.a, f.text FROM rx_texts, LATERAL rx_find_all(t, '\\d') f WHERE id = 1 ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [(0, 4, "1"), (1, 5, "2")]
    # all arguments, in the kernel and written as built-in functions
    calls = {
        "rx_matches(t, 'AB', 'i')": True, "rx_find(t, 'B|1', 'i')": "b", "rx_find(t, 'b', '', 2)": "b", "rx_extract(t, '(?<k>b)(?<v>x)?', 'k')": "b", "rx_extract(t, '(b)(x)?', 2)": None, "rx_extract(t, '(b)', 'none')": None,
        "rx_find_all_text(t, '([ab])c?', 1)": ["a", "b", "a", "b"], "rx_count(t, 'A', 'i')": 2, "rx_replace(t, '(a)(b)', '$2$1', 1)": "bac 12 ab", r"rx_replace(t, r'\\s+', '_')": "abc_12_ab", "rx_split(t, ' ', 1)": ["abc", "12 ab"],
        "rx_find_backward(t, '[a-z]')": "b", "rx_match_at(t, '1', 4).found": True, "rx_search(t, '(b)').boundaries[1].a": 1, "rx_search_backward(t, 'a').boundaries[0].a": 7, "rx_split(t, '( )')": ["abc", " ", "12", " ", "ab"],
    }
    where = " FROM rx_texts WHERE id = 1"
    for call, want in calls.items():
        assert spark.sql(f"SELECT {call}{where}".replace("\\\\", "\\")).first()[0] == want, call
        assert sql.sql(spark, f"SELECT {call}{where}".replace("\\\\", "\\")).first()[0] == want, call
    plan_ = sql.sql(spark, "SELECT id FROM rx_texts WHERE rx_matches(t, 'ab[0-9c]+') AND rx_count(t, '(?i)[a-z]+') > 0")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan_ and "RLIKE" in plan_ and "Contains" in plan_
    assert sql.rewrite("SELECT 'rx_count(t, 1)', rx_count(t, p) /* rx_count(t, 'a') */") == "SELECT 'rx_count(t, 1)', rx_count(t, p) /* rx_count(t, 'a') */"
    assert sql.rewrite("SELECT rx_count(rx_replace(t, 'a', ','), 'b')") == "SELECT regexp_count((regexp_replace((t), 'a', ',')), 'b')"


def test_pattern_tags(df):
    patterns = {"digits": r"\d+", "nested": r"\((?:[^()]++|\g<0>)*\)", "license": "(?i)K+", "none": "qqq"}
    out = tag_by_patterns(df, "t", patterns)
    got = {label: {r.id for r in out.collect() if r.label == label} for label in patterns}
    assert got == {label: {r.id for r in df.select("id", rx.matches("t", p).alias("m")).collect() if r.m} for label, p in patterns.items()}
    assert tag_by_patterns(df, "t", {}).count() == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "aab"), ("2024-01-01 00:20:00", "b"), ("2024-01-01 01:10:00", "a")], "at string, t string").select(F.col("at").cast("timestamp").alias("ts"), "t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_hits(stream, "t", "ts", "a").writeStream.outputMode("complete").format("memory").queryName("rx_hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.n_rows, r.n_hit, r.n_matches) for r in spark.sql("SELECT * FROM rx_hits").collect())
    assert got == [(1, 1, 1), (2, 1, 2)]


def test_kernel_batches(spark):
    """The kernel's batches are bounded by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    rx.find("t", r"(a)(?1)?b\g<0>?")
    assert spark.conf.get(key) == str(rx.BATCH_BYTES)
    spark.conf.set(key, "1000000")
    register(spark)
    rx.find("t", r"(a)(?1)?b\g<0>?")
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)


@pytest.mark.parametrize("name", ["html_tag_balanced", "paren_recursion"])
def test_kernel_runs_once(spark, tmp_path, name):
    """A query that keeps the rows with a hit runs the kernel once, not for its filter as well."""
    for t, c, x in (("pages", "page_id", "html"), ("documents", "doc_id", "text")):
        spark.createDataFrame([(1, "a<title>b</title>(c(d))"), (2, "e"), (3, None)], f"{c} bigint, {x} string").write.parquet(str(tmp_path / f"{t}.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in df.collect()] == [(1, "<title>b</title>" if name == "html_tag_balanced" else "(c(d))")]


def test_pushdown(spark, tmp_path):
    spark.range(5).select(F.col("id").cast("string").alias("t")).write.parquet(str(tmp_path / "p"))
    text = spark.read.parquet(str(tmp_path / "p")).where(rx.matches("t", r"abc\d+"))._jdf.queryExecution().toString()
    assert "StringContains(t,abc)" in text
