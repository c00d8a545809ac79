"""Reading the star-schema tables and pattern tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import matches
from ..operators.api import regex
from ..plans.planner import plan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pattern_table(spark: SparkSession, patterns: dict[str, str], flags: str = "") -> DataFrame:
    """label, pattern, tier and the literal that a match needs, of a table of patterns."""
    rows = [(label, p, plan(rx := regex(p, flags), "matches").tier, plan(rx, "matches").required) for label, p in patterns.items()]
    return spark.createDataFrame(rows, "label string, pattern string, tier string, required string")


def tag_by_patterns(df: DataFrame, text: Column | str, patterns: dict[str, str], flags: str = "") -> DataFrame:
    """Rows of df for each of the patterns that occurs in ``text``, with its ``label``.

    The patterns are known when the plan is made, so each is a constant of one
    scan, whatever its tier; a text is tested by all of them where it is read.
    """
    hit = [F.when(matches(text, p, flags), F.lit(label)) for label, p in patterns.items()]
    labels = F.filter(F.array(*hit), lambda x: x.isNotNull()) if hit else F.array().cast("array<string>")
    return df.select("*", F.explode(labels).alias("label"))
