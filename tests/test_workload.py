"""The lexer workload against Python's own matcher, in both tiers."""

import re

import pytest

from rexmill.operators import api
from rexmill.operators.api import regex
from rexmill.plans.planner import plan
from rexmill.workload import LEXER, LINES, lexer_counts, lines_table


@pytest.mark.parametrize("tier", ["", "kernel"])
def test_counts(spark, tier):
    lines = lines_table(spark, 25)
    texts = [r.line for r in lines.orderBy("line_no").collect()]
    assert texts == [LINES[i % 10] + "\n" for i in range(25)]
    more = [None, "", 'say "a \\" b" and "', "x =\n  y = 1.5", "((a)(b", "12_u8 3'i64 4.0 0xFfg", '"' * 7, "été = 1"]
    df = lines.select("line").union(spark.createDataFrame([(t,) for t in more], "line string"))
    got = {r.label: r.n for r in lexer_counts(df, "line", "", tier).collect()}
    assert got == {k: sum(sum(1 for _ in re.finditer(p, t or "")) for t in texts + more) for k, p in LEXER.items()}
    assert {r.n for r in lexer_counts(df.limit(0), "line", "", tier).collect()} == {0}


def test_all_native():
    assert {plan(regex(p), "count").tier for p in LEXER.values()} == {"native"}


CAPTURES = [
    # pattern, subject, spans of the match and its groups
    (r"(?<=(\d))\w", "1a", [(1, 2), (0, 1)]),
    (r"(?<=(a)|(bb))X", "bbX", [(2, 3), (-1, -1), (0, 2)]),
    (r"(?<!(\d))[a-z]", "9a b", [(3, 4), (-1, -1)]),
    (r"(?=(\d+))\w+", "abc123def", [(3, 9), (3, 6)]),
    ("(?:(a)|b)*", "ab", [(0, 2), (0, 1)]),
    ("(a)+b", "aab", [(0, 3), (1, 2)]),
    ("(a)(?1)", "aa", [(0, 2), (1, 2)]),
    ("(?L)(a)|(abc)", "abc", [(0, 3), (-1, -1), (0, 3)]),
    (r"(a)\K(b)", "ab", [(1, 2), (0, 1), (1, 2)]),
    (r"([\pL]=(abc))*X", "L=abcX", [(0, 6), (0, 5), (2, 5)]),
]


@pytest.mark.parametrize("pattern,subject,want", CAPTURES)
def test_captures(pattern, subject, want):
    assert api.search(regex(pattern), subject) == want
