"""The lexer workload: 14 patterns counted over lines of source code, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as rx

# The workload's patterns.
LEXER = {
    "int-literal-suffix": r"\b\d+(['_]?[iIuU](8|16|32|64))?\b",
    "type-keywords": r"\b(int|int8|int16|int32|int64|uint|uint8|uint16|uint32|uint64|float|float32|float64|bool|char|string|seq|array|tuple|object|ref|ptr|var|const|let|proc|func|method|iterator|template|macro|type|enum|range|set|cstring|pointer|typed)\b",
    "control-keywords": r"\b(import|export|include|from|as|when|elif|else|case|of|if|while|for|in|notin|is|isnot|return|yield|break|continue|discard|raise|try|except|finally|defer|do|block|static|cast|new|sizeof|addr|and|or|xor|not|shl|shr|div|mod)\b",
    "identifier": r"\b[A-Za-z_][A-Za-z0-9_]*\b",
    "if-elif-else-keywords": r"\b(if|elif|else|case|of|while|for|in|notin|is|isnot|return|yield|break|continue|discard|raise|try|except|finally|defer)\b",
    "double-quoted-string": r'"([^"\\]|\\.)*"',
    "line-comment": "#.*",
    "PascalCase": "[A-Z][A-Za-z0-9_]*",
    "float-literal": r"\d+\.\d+",
    "operator-run": r"[+\-*/=<>!&|^~%]+",
    "paren-group": r"\(.*?\)",
    "hex-literal": "0[xX][0-9A-Fa-f]+",
    "assignment-lhs": r"[A-Za-z_][A-Za-z0-9_]*\s*=",
    "whitespace-run": r"\s+",
}

# The workload's lines, cycled.
LINES = [
    '  let x = foo(123_i32, "hello", 0xDEADBEEF) # initialize',
    '  for i in 0 ..< n: result.add Item(name: "x", count: i + 1)',
    "type Foo = ref object of RootObj  ## a comment about Foo",
    "proc bar*[T](xs: seq[T]; threshold: float = 1.5): bool =",
    "  if a == b and c != d or not flag: result = true",
    'var pos: int = 0; const tag: string = "abc-123"',
    "while i < len(s):  result &= chr(ord(s[i]) xor 0x20'u8); inc i",
    "  return Match(found: true, boundaries: @[span(0, 4), span(5, 11)])",
    'discard fmt"{n:08X} {label:<12} {value:>6.2f}us"',
    "import std/[monotimes, strformat, strutils, tables, sequtils]",
]


def lines_table(spark: SparkSession, n: int) -> DataFrame:
    """line_no, line: ``n`` lines, each with its newline."""
    cycle = F.array(*[F.lit(line + "\n") for line in LINES])
    return spark.range(n).select(F.col("id").alias("line_no"), F.get(cycle, F.pmod("id", F.lit(len(LINES))).cast("int")).alias("line"))


def lexer_counts(df: DataFrame, text: Column | str, flags: str = "", tier: str = "") -> DataFrame:
    """label, n: matches of every pattern in a text column; null texts hold none.

    All patterns are counted in one pass, summed before the shuffle of one row a task.
    """
    sums = df.agg(*[F.coalesce(F.sum(rx.count(text, p, flags, tier)), F.lit(0)).alias(label) for label, p in LEXER.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("n")) for label in LEXER])).alias("x")).select("x.label", "x.n")
