"""Phrase search: candidates that hold all tokens, then the positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(rows: DataFrame, phrase: list[str], key: list[str]) -> DataFrame:
    """Keys of the items of ``rows`` (key, token) that hold every token of the phrase; an empty phrase has none."""
    wanted = sorted(set(phrase))
    return rows.filter(F.col("token").isin(wanted)).groupBy(*key).agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(wanted) if wanted else F.lit(False)).select(*key)


def matches(sentences: DataFrame, phrase: list[str], mode: str = "exact") -> DataFrame:
    """The rows of ``sentences`` (.., tokens) in which the tokens of the phrase follow one another.

    ``exact`` finds every match.  ``reference`` scans once and, after a mismatch, goes on behind it
    without trying the tokens again, so that ``a a b`` isn't found in ``a a a b``.
    """
    if not phrase:
        return sentences.filter(F.lit(False))
    if mode == "exact":
        mark = "\u0001"  # in no token
        line = F.concat(F.lit(mark), F.array_join("tokens", mark), F.lit(mark))
        return sentences.filter(line.contains(mark + mark.join(phrase) + mark))
    words = F.array(*map(F.lit, phrase))
    step = lambda at, t: F.when(at == len(phrase), at).when(F.get(words, at) == t, at + 1).otherwise(F.lit(0))
    return sentences.filter(F.aggregate("tokens", F.lit(0), step) == len(phrase))
