"""One query per operator, over whole tables with production parameters, and SQL where it can express it.

Every query gives one row for each row of its table, repeated rows included, and
none for an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, mixing, ngram_join, quality_rules, secret_scan, suffix_dedup, toxicity, warc
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at 3-word shingles and similarity 0.9; rows without words are linked with nothing, a null doc_id is larger than any other."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that repeat an earlier one, exactly or nearly, and the hash of the text that the others make; a null text has no lines."""
    out = line_dedup.dedup_documents(table(spark, sf_dir, "documents"), equal_chars=line_dedup.EQUAL_CHARS)
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("kept", F.lit("")), 256)).drop("kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 200-byte string occurring elsewhere covers; null texts are empty, equal rows count as occurrences of each other."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; a null source is one of its own, a null text has size 0, equal rows are interchangeable."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text, learned from rows that aren't held out; ``und`` for null texts and those without a letter."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and verdict of each document; null and empty texts score the base rate."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "toxic")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each document; null texts have no words and fail."""
    out = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, through a ledger of its distinct texts; null texts are empty."""
    found, _ = secret_scan.scan_paths(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(found)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each row holds; rows without doc_id and rows that share one are judged by their own texts."""
    out = decontaminate.tag_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each page, written and read back; a null html is an empty payload."""
    packages = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline; see there."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_line_dedup, op3_suffix_array_dedup, op4_mix_sources, op5_language_id, op6_toxicity, op7_quality_rules, op8_secret_scan, op9_decontamination, op10_warc, pipeline)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, {_AZ}), ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

# a line within one edit of another agrees with it in its first or its second half, by the shorter one's length
_OP2 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, no, line FROM l WHERE length(line) >= {line_dedup.MIN_CHARS} OR regexp_matches(line, '[^\x20\x09-\x0D]')
), f AS (
  SELECT line, length(line) AS n, min({{'d': doc_id, 'n': no}}) AS pos FROM t GROUP BY line
), k AS (
  SELECT line, n, pos, unnest([{{'m': n, 'side': 0, 'part': substr(line, 1, n // 2)}}, {{'m': n, 'side': 1, 'part': substr(line, n // 2 + 1)}},
    {{'m': n - 1, 'side': 0, 'part': substr(line, 1, (n - 1) // 2)}}, {{'m': n - 1, 'side': 1, 'part': substr(line, (n - 1) // 2 + 2)}}]) AS key
  FROM f WHERE n >= {line_dedup.MIN_CHARS}
), p AS (
  SELECT DISTINCT a.line AS line, least(a.line, b.line) AS u, greatest(a.line, b.line) AS v FROM k a JOIN k b ON a.key = b.key AND a.line <> b.line AND b.pos < a.pos AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT line FROM (SELECT line, CASE WHEN length(u) <= length(v) THEN u ELSE v END AS x, CASE WHEN length(u) <= length(v) THEN v ELSE u END AS y FROM p)
  WHERE len(list_filter(range(1, length(y) + 1), lambda i: substr(x, 1, i - 1) = substr(y, 1, i - 1) AND substr(x, i + CASE WHEN length(x) = length(y) THEN 1 ELSE 0 END) = substr(y, i + 1))) > 0
), c AS (
  SELECT t.doc_id, count(*) FILTER (WHERE f.pos <> {{'d': t.doc_id, 'n': t.no}}) AS n_equal, count(*) FILTER (WHERE f.pos = {{'d': t.doc_id, 'n': t.no}} AND near.line IS NOT NULL) AS n_near
  FROM t JOIN f ON t.line = f.line LEFT JOIN near ON near.line = t.line GROUP BY t.doc_id
), g AS (
  SELECT t.doc_id, t.no FROM t JOIN f ON t.line = f.line LEFT JOIN near ON near.line = t.line WHERE f.pos <> {{'d': t.doc_id, 'n': t.no}} OR near.line IS NOT NULL
), s AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.no = l.no WHERE g.no IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

# every 200-byte string of every text, as 400 hex digits
_OP3 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, unnest(range(n - 199)) AS p, unnest(list_transform(range(n - 199), lambda p: hash(substr(h, 2 * p + 1, 400)))) AS g FROM d WHERE n >= 200
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1
), s AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (
    SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r))
  GROUP BY doc_id, run
), z AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list([a, b] ORDER BY a) AS spans, max(b) AS last FROM s GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE
    array_to_string(list_transform(range(1, len(spans) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE spans[i - 1][2] END) + 1, 2 * (spans[i][1] - CASE WHEN i = 1 THEN 0 ELSE spans[i - 1][2] END))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""

_OP10 = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""


def _op8_rule(i: int, rule: secret_scan.Rule) -> str:
    quoted = rule.pattern.replace("'", "''")
    size = f"length(regexp_extract(m[i], '{quoted}', {rule.group}))" if rule.group else "length(m[i])"
    return f"""SELECT doc_id, {i} AS k, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'e': list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), 'n': length(m[i]), 'c': {size}}}),
      lambda h: h.c >= {rule.least})) AS h
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}') AS m, regexp_split_to_array(coalesce(text, ''), '{quoted}') AS p FROM documents)"""


_KINDS = ", ".join(f"'{r.kind}'" for r in secret_scan.RULES)
_OP8 = f"""
WITH f AS (SELECT doc_id, k, (h.e - h.n)::BIGINT AS s, h.e::BIGINT AS e FROM ({" UNION ALL ".join(_op8_rule(i, r) for i, r in enumerate(secret_scan.RULES))})),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg([{_KINDS}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
  string_agg([{_KINDS}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL = {"op1_ngram_jaccard_join": _OP1, "op2_line_dedup": _OP2, "op3_suffix_array_dedup": _OP3, "op8_secret_scan": _OP8, "op10_warc": _OP10}
