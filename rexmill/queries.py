"""Driver queries of the pattern operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constructs
from .functions import columns as rx
from .functions.sql import find_all_table
from .functions.sql import sql as rx_sql
from .sources.tables import table, tag_by_patterns
from .streaming.stateless import windowed_hits
from .workload import LEXER, LINES, lexer_counts, lines_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
_IPV4_SQL = r"\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def filter_email(spark, d):
    return table(spark, d, "documents").where(rx.matches("text", EMAIL)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|copyright|spdx')")
def filter_license_ci(spark, d):
    return table(spark, d, "documents").where(rx.matches("text", "licen[sc]e|copyright|spdx", "i")).select("doc_id")


@query(f"SELECT lang, count(*) AS n, count(DISTINCT hit) AS n_distinct FROM (SELECT lang, unnest(regexp_extract_all(text, '{EMAIL}')) AS hit FROM documents) GROUP BY lang")
def email_by_lang(spark, d):
    hits = table(spark, d, "documents").select("lang", F.explode(rx.find_all("text", EMAIL)).alias("hit"))
    return hits.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("hit").alias("n_distinct"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_IPV4_SQL}')) AS ip FROM documents")
def ip_extract_all(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(rx.find_all("text", IPV4)).alias("ip"))


@query(rf"SELECT lang, sum(len(regexp_extract_all(text, '{WORD}')))::BIGINT AS n_words FROM documents GROUP BY lang")
def word_count_by_lang(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(rx.count("text", r"\w+")).alias("n_words"))


@query(r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}+')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 20")
def pascal_case_top20(spark, d):
    words = table(spark, d, "documents").select(F.explode(rx.find_all("text", r"\p{Lu}\p{Ll}+")).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20)


@query(r"""SELECT event_type, sum(TRY_CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""")
def events_props_k(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(rx.extract("props", r'"k": (\d+)', 1).cast("long")).alias("total"))


@query(r"SELECT c_custkey, regexp_extract(c_name, '^(\w+)#(\d+)$', 1) AS kind, regexp_extract(c_name, '^(\w+)#(\d+)$', 2)::BIGINT AS num FROM customer")
def cust_no_named(spark, d):
    s = rx.extract_struct("c_name", r"\A(?<kind>\w+)#(?<num>\d+)\z")
    return table(spark, d, "customer").select("c_custkey", s.alias("s")).select("c_custkey", "s.kind", F.col("s.num").cast("long").alias("num"))


_URL = r"\A(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_URL_SQL = r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@query(f"SELECT page_id, regexp_extract(url, '{_URL_SQL}', 1) AS scheme, regexp_extract(url, '{_URL_SQL}', 2) AS host, regexp_extract(url, '{_URL_SQL}', 3) AS path, CASE WHEN contains(url, '?') THEN regexp_extract(url, '{_URL_SQL}', 4) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '{_URL_SQL}', 5) END AS fragment FROM pages")
def url_parts(spark, d):
    """Optional groups are null when they took no part, so this runs in the kernel."""
    s = rx.extract_struct("url", _URL)
    return table(spark, d, "pages").select("page_id", s.alias("s")).select("page_id", F.col("s.g1").alias("scheme"), F.col("s.g2").alias("host"), F.col("s.g3").alias("path"), F.col("s.g4").alias("query"), F.col("s.g5").alias("fragment"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{EMAIL}', '<email>', 'g'), '{_IPV4_SQL}', '<ip>', 'g')) AS redacted FROM documents")
def redact_pii(spark, d):
    out = rx.replace(rx.replace("text", EMAIL, "<email>"), IPV4, "<ip>")
    return table(spark, d, "documents").select("doc_id", F.md5(out).alias("redacted"))


@query(r"SELECT o_orderkey, regexp_replace(o_orderpriority, '(\d)-(\w+)', '\2-\1', 'g') AS swapped FROM orders")
def swap_groups(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rx.replace("o_orderpriority", r"(\d)-(\w+)", "$2-$1").alias("swapped"))


@query(r"SELECT o_orderkey, regexp_replace(o_orderpriority, '[A-Z]', '_') AS masked FROM orders")
def replace_first_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rx.replace("o_orderpriority", "[A-Z]", "_", count=1).alias("masked"))


@query(r"SELECT doc_id, len(regexp_split_to_array(text, '[.!?]+\s'))::INT AS n_sentences FROM documents")
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(rx.split("text", r"[.!?]+[ \t\n\r\f\v]")).alias("n_sentences"))


@query("SELECT s_suppkey, array_to_string([regexp_extract(s_name, '^([^#]*)(#)(.*)$', 1), '#', regexp_extract(s_name, '^([^#]*)(#)(.*)$', 3)], '|') AS pieces FROM supplier")
def split_keep_delims(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(rx.split("s_name", "(#)"), "|").alias("pieces"))


_SPAN_SQL = "strlen(regexp_extract(text, '^((?s:.*?))ß', 1))"


@query(f"SELECT doc_id, CASE WHEN contains(text, 'ß') THEN {_SPAN_SQL} ELSE -1 END::INT AS a, CASE WHEN contains(text, 'ß') THEN {_SPAN_SQL} + 2 ELSE -1 END::INT AS b FROM documents")
def match_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.find_span("text", "ß").alias("s")).select("doc_id", "s.a", "s.b")


@query(r"SELECT doc_id, list_last(regexp_extract_all(text, '\p{Nd}')) AS last_digit FROM documents")
def backward_last_number(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.find_backward("text", r"\d").alias("last_digit"))


@query(r"SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#1')")
def match_at_zero(spark, d):
    return table(spark, d, "part").where(rx.starts_with("p_brand", r"Brand#1")).select("p_partkey")


@query(rf"SELECT doc_id, regexp_extract_all(text, '({WORD}),', 1)[1] AS w FROM documents")
def lookahead_word_before_comma(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.find("text", r"\w+(?=,)").alias("w"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, 'token = ("[0-9a-f]+)', 1), '') AS v FROM documents""")
def lookbehind_after_eq(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.find("text", r'(?<=token = )"[0-9a-f]+').alias("v"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(text, '{c}{c}')" for c in "aeot"))
def dup_adjacent_letter(spark, d):
    return table(spark, d, "documents").where(rx.matches("text", r"([aeot])\1")).select("doc_id")


_EDGE_SQL = r"[^\p{L}\p{M}\p{N}\p{Pc}]"


@query(f"""SELECT doc_id FROM (
  SELECT doc_id, list_transform(w, lambda x: regexp_extract(x, '(?:^|{_EDGE_SQL})([a-z]{{4,12}})$', 1)) AS a, list_transform(w, lambda x: regexp_extract(x, '^([a-z]{{4,12}})(?:{_EDGE_SQL}|$)', 1)) AS b
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
WHERE len(list_filter(range(1, len(a)), lambda i: a[i] <> '' AND a[i] = b[i + 1])) > 0""")
def doubled_word(spark, d):
    return table(spark, d, "documents").where(rx.matches("text", r"\b([a-z]{4,12})\x20\1\b")).select("doc_id")


def _if_any(hit):
    """A row for a hit, none for null. A filter would run the kernel a second time, as it is pushed below what it tests."""
    return F.explode(F.array_compact(F.array(hit)))


_NESTED_SQL = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"  # SQL has no recursion: four levels, more than the tables hold


@query(f"SELECT doc_id, regexp_extract(text, '{_NESTED_SQL}', 0) AS hit FROM documents WHERE regexp_matches(text, '{_NESTED_SQL}')")
def paren_recursion(spark, d):
    return table(spark, d, "documents").select("doc_id", _if_any(rx.find("text", r"\((?:[^()]++|\g<0>)*\)")).alias("hit"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 0) AS hit FROM pages WHERE regexp_matches(html, '<title>([^<]*)</title>')")
def html_tag_balanced(spark, d):
    hit = rx.find("html", r"(?<tag><(?<n>title)>(?:[^<]++|\g<tag>)*</\k<n>>)")
    return table(spark, d, "pages").select("page_id", _if_any(hit).alias("hit"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<script>.*?</script>', 0) AS script FROM pages WHERE regexp_matches(html, '(?s)<script>.*?</script>')")
def absent_comment(spark, d):
    return table(spark, d, "pages").select("page_id", rx.find("html", r"<script>(?~</script>)</script>").alias("script")).where("script is not null")


@query("SELECT p_partkey, CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, 1, instr(p_brand, '#') - 1) ELSE p_brand END AS head FROM part")
def absent_range(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.find("p_brand", r"(?~|#).*").alias("head"))


@query(r"SELECT c_custkey, regexp_extract(c_name, '0{0,3}', 0) AS z FROM (SELECT c_custkey, substr(c_name, 10) AS c_name FROM customer)")
def callout_max3(spark, d):
    return table(spark, d, "customer").select("c_custkey", rx.find(F.substring("c_name", 10, 99), r"(?:0(*MAX{3}))*").alias("z"))


@query(r"""SELECT doc_id, regexp_extract(text, '= ("[^"]*"|[^ "]+)', 0) AS v FROM documents WHERE regexp_matches(text, '= ("[^"]*"|[^ "]+)')""")
def cond_quote(spark, d):
    hit = rx.find("text", r'= (")?(?(1)[^"]*"|[^ "]+)')
    return table(spark, d, "documents").select("doc_id", hit.alias("v")).where("v is not null")


@query("SELECT c_custkey, substr(c_name, instr(c_name, '#') + 1) AS v FROM customer")
def keep_out(spark, d):
    return table(spark, d, "customer").select("c_custkey", rx.find("c_name", r"Customer#\K.*").alias("v"))


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) > 2 THEN o_orderpriority END AS longest FROM orders")
def longest_alt(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rx.find("o_orderpriority", r"(?L)\d-|\d-[A-Z ]+(?:[A-Z]+)?|[A-Z]").alias("longest"))


@query("SELECT s_suppkey, length(s_name)::INT AS n FROM supplier")
def grapheme_count(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", rx.count("s_name", r"\X").alias("n"))


@query("SELECT s_suppkey, replace(s_name, '#', '|#|') AS segments FROM supplier")
def word_segments(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(rx.find_all("s_name", r"(?y{w})."), "|").alias("segments"))


_PATTERNS = {"email": EMAIL, "ip": IPV4, "license": "(?i)licen[sc]e", "digits": r"\d{6,}"}


@query(f"SELECT label, count(*) AS n FROM documents JOIN (VALUES ('email', '{EMAIL}'), ('ip', '{_IPV4_SQL}'), ('license', '(?i)licen[sc]e'), ('digits', '\\p{{Nd}}{{6,}}')) t(label, p) ON regexp_matches(text, p) GROUP BY label")
def pattern_table_join(spark, d):
    return tag_by_patterns(table(spark, d, "documents").select("text"), "text", _PATTERNS).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id AND (regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{_IPV4_SQL}')))")
def docs_without_pii(spark, d):
    docs = table(spark, d, "documents")
    hit = docs.where(rx.matches("text", EMAIL) | rx.matches("text", IPV4)).select("doc_id")
    return docs.select("doc_id").join(hit, "doc_id", "left_anti")


@query(r"SELECT c_custkey, i AS match_no, (9 + i)::INT AS a, CASE WHEN i > 0 THEN 1 END::INT AS gap FROM (SELECT c_custkey, unnest(range(0, 9)) AS i FROM customer)")
def match_gap_window(spark, d):
    """Distance between the starts of neighbouring matches."""
    hits = table(spark, d, "customer").select("c_custkey", F.posexplode(rx.find_all_spans("c_name", r"\d")).alias("match_no", "m"))
    hits = hits.select("c_custkey", F.col("match_no").cast("long").alias("match_no"), F.col("m")[0]["a"].alias("a"))
    return hits.withColumn("gap", F.col("a") - F.lag("a").over(Window.partitionBy("c_custkey").orderBy("match_no")))


@query(r"SELECT conv_id, turn, regexp_extract(text, '\p{Lu}\p{L}*', 0) AS first_capital FROM conversations WHERE regexp_matches(text, '\p{Lu}\p{L}*')")
def first_capital_by_turn(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rx.find("text", r"\p{Lu}\p{L}*").alias("first_capital")).where("first_capital is not null")


@query("SELECT n_nationkey, 0::INT AS match_no, 0::INT AS a, strlen(n_name)::INT AS b, n_name AS text FROM nation")
def lateral_find_all(spark, d):
    """The table function: one row per match."""
    spark.udtf.register("rx_find_all", find_all_table())
    table(spark, d, "nation").createOrReplaceTempView("rx_nation")
    return spark.sql(r"SELECT n_nationkey, f.match_no, f.a, f.b, f.text FROM rx_nation, LATERAL rx_find_all(n_name, '.+') f WHERE f.group_no = 0")


@query("""SELECT date_trunc('hour', ts) AS start, count(*) AS n_rows, count(*) FILTER (contains(event_type, 'c'))::BIGINT AS n_hit, sum(length(event_type) - length(replace(event_type, 'c', '')))::BIGINT AS n_matches FROM events GROUP BY 1""")
def windowed_matches(spark, d):
    return windowed_hits(table(spark, d, "events"), "event_type", "ts", "c")


@query(r"SELECT lang, role_hit, count(*) AS n FROM (SELECT lang, regexp_matches(text, '[%*#]{3}') AS role_hit FROM documents) GROUP BY CUBE (lang, role_hit)")
def junk_cube(spark, d):
    return table(spark, d, "documents").select("lang", rx.matches("text", "[%*#]{3}").alias("role_hit")).cube("lang", "role_hit").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, regexp_extract(s_name, '^[^0-9]*') || CAST(CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) AS VARCHAR) AS name FROM supplier")
def replace_callback(spark, d):
    """Replacement by a function of the spans: numbers without leading zeros."""
    name = rx.replace_with("s_name", r"\d+", lambda spans, text: str(int(text[slice(*spans[0])])))
    return table(spark, d, "supplier").select("s_suppkey", name.alias("name"))


@query("SELECT c_custkey, '8 .. ' || (9 + length(regexp_extract(c_name, '0+'))) AS whole, 2 + 1 AS n, true AS has_mark, false AS has_x, '#' AS mark, NULL::VARCHAR AS x, regexp_extract(c_name, '0+') AS zeros FROM customer")
def match_accessors(spark, d):
    """Accessors of a match by number and by name; unset groups are null."""
    pattern = r"(?<mark>#)(?<x>x)?(?<zeros>0+)"
    m = F.col("m")
    hits = table(spark, d, "customer").select("c_custkey", "c_name", rx.find_struct("c_name", pattern).alias("m"))
    named = {k: rx.capture_text("c_name", m, k, pattern).alias(k) for k in ("mark", "x", "zeros")}
    return hits.select("c_custkey", rx.span_text(rx.match_span(m)).alias("whole"), rx.group_count(m).alias("n"), rx.captured(m, 0).alias("has_mark"), rx.captured(m, "x", pattern).alias("has_x"), *named.values())


@query("SELECT '(?<y>\\d{4})-(?<m>\\d\\d)' AS pattern, 2 AS capture_count, 'y=0,m=1' AS names")
def pattern_metadata(spark, d):
    out = rx.describe(spark, r"(?<y>\d{4})-(?<m>\d\d)")
    names = F.array_join(F.transform("named_captures", lambda x: F.concat_ws("=", x["name"], x["idx"])), ",")
    return out.select("pattern", "capture_count", names.alias("names"))


@query("SELECT c_custkey, true AS gave_up FROM customer")
def step_limit_null(spark, d):
    """A search that passes its step limit is null instead of an error."""
    return table(spark, d, "customer").select("c_custkey", rx.matches("c_name", r"(?:\w|\w\w|#)*\g<0>?z", step_limit=200, on_error="null").isNull().alias("gave_up"))


@query("SELECT c_custkey, regexp_extract(c_name, '0{1,4}') AS zeros FROM customer")
def call_limit(spark, d):
    """Calls deeper than the limit fail without an error."""
    return table(spark, d, "customer").select("c_custkey", rx.find("c_name", r"(?<p>0\g<p>?)", call_limit=3).alias("zeros"))


@query("SELECT c_custkey, 'Cust|m|' || substr(c_name, 8) AS pieces, substr(c_name, 1, 4) || '<o>m<e>' || substr(c_name, 8) AS marked FROM customer")
def limited_pieces(spark, d):
    """The first pieces of a split, and the first replacements with a group."""
    pieces = F.array_join(rx.split("c_name", "[aeio]", 2), "|")
    return table(spark, d, "customer").select("c_custkey", pieces.alias("pieces"), rx.replace("c_name", "([aeio])", "<$1>", count=2).alias("marked"))


@query("SELECT c_custkey, substr(c_name, 13) AS rest, '9 .. ' || (9 + length(regexp_extract(c_name, '0+'))) AS zeros, '17 .. 18' AS tail, '8 .. 9' AS mark FROM customer")
def positions(spark, d):
    """Searches from a position: forward, exactly there, and backward."""
    text = lambda m: rx.span_text(rx.match_span(m))
    return table(spark, d, "customer").select("c_custkey", rx.find("c_name", r"\d+", start=12).alias("rest"), text(rx.match_at("c_name", "0+", 9)).alias("zeros"), text(rx.backward_struct("c_name", r"\d")).alias("tail"), text(rx.backward_struct("c_name", r"\W", start=12)).alias("mark"))


@query(f"(SELECT doc_id FROM documents WHERE regexp_matches(text, '{EMAIL}') INTERSECT SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the')) EXCEPT SELECT doc_id FROM documents WHERE regexp_matches(text, '{_IPV4_SQL}') UNION ALL SELECT doc_id FROM documents WHERE regexp_matches(text, '[%*#]{{3}}')")
def set_operations(spark, d):
    docs = table(spark, d, "documents")
    of = lambda p, flags="": docs.where(rx.matches("text", p, flags)).select("doc_id")
    return of(EMAIL).intersect(of("the", "i")).exceptAll(of(IPV4)).union(of("[%*#]{3}"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n, sum(len(regexp_extract_all(event_type, 'c')))::BIGINT AS n_matches FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, run""")
def session_matches(spark, d):
    return windowed_hits(table(spark, d, "events"), "event_type", "ts", "c", session="30 minutes", keys=("user_id",)).select("user_id", "start", F.col("n_rows").alias("n"), "n_matches")


@query("""SELECT start, count(*) AS n_rows, sum(hit)::BIGINT AS n_hit FROM (
  SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, CASE WHEN contains(event_type, 'c') THEN 1 ELSE 0 END AS hit FROM events)
GROUP BY start""")
def sliding_matches(spark, d):
    return windowed_hits(table(spark, d, "events"), "event_type", "ts", "c", window="2 hours", slide="1 hour").select("start", "n_rows", "n_hit")


@query(r"""SELECT CAST(make_date(2024, 1 + k % 12, 1) AS VARCHAR) AS month, count(*) AS n, sum(sqrt(k * k))::BIGINT AS total FROM (SELECT CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k FROM events WHERE regexp_matches(props, '"k": \d+')) GROUP BY 1""")
def date_json_functions(spark, d):
    """Captures as JSON fields, numbers and dates."""
    found = table(spark, d, "events").select(rx.find("props", r'\{[^{}]*"k": \d+[^{}]*\}').alias("json")).where("json is not null")
    k = F.get_json_object("json", "$.k").cast("long")
    month = F.make_date(F.lit(2024), (F.lit(1) + k % 12).cast("int"), F.lit(1)).cast("string")
    return found.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.sum(F.sqrt(k * k)).cast("long").alias("total"))


@query("SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?i)[a-z]{4,}')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, w LIMIT 20")
def ci_word_top20(spark, d):
    """A caseless loop, which runs natively."""
    words = table(spark, d, "documents").select(F.explode(rx.find_all("text", "[a-z]{4,}", flags="i")).alias("w")).select(F.lower("w").alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20)


@query("SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '//((?:[a-z0-9-]+[.])*[a-z0-9-]+)[:/]?', 1) AS host FROM pages) GROUP BY host")
def host_extract(spark, d):
    hosts = table(spark, d, "pages").select(rx.extract("url", r"//((?:[a-z0-9-]+\.)*+[a-z0-9-]*)[:/]?", 1).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '(?i)licen[sc]e')))::BIGINT AS licences FROM documents WHERE regexp_matches(text, '{EMAIL}') GROUP BY lang")
def sql_functions(spark, d):
    """A query whose constant patterns are written as built-in functions."""
    table(spark, d, "documents").createOrReplaceTempView("rx_documents")
    return rx_sql(spark, f"SELECT lang, count(*) AS n, sum(rx_count(text, 'licen[sc]e', 'i')) AS licences FROM rx_documents WHERE rx_matches(text, r'{EMAIL}') GROUP BY lang")


def _lexer_sql(source: str) -> str:
    counts = [f"SELECT '{label}' AS label, coalesce(sum(len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))), 0)::BIGINT AS n FROM src" for label, p in LEXER.items()]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(counts)


@query(_lexer_sql("SELECT html AS t FROM pages"))
def lexer_pages(spark, d):
    """The lexer patterns over all pages, with ASCII types as the SQL has them."""
    return lexer_counts(table(spark, d, "pages"), "html", "WDS")


_LINES_SQL = ", ".join("(" + repr(i) + ", '" + line.replace("'", "''") + "' || chr(10))" for i, line in enumerate(LINES))


@query(_lexer_sql(f"SELECT t FROM range(100000) r(i) JOIN (VALUES {_LINES_SQL}) l(k, t) ON r.i % {len(LINES)} = l.k"))
def lexer_lines(spark, d):
    """The lexer workload itself: 100,000 lines of source code."""
    return lexer_counts(lines_table(spark, 100_000), "line")


QUERIES |= constructs.QUERIES
ORACLE_SQL |= constructs.ORACLE_SQL
