"""Weights of a term-document matrix and the choice of its columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.operators import coo
from mathquarry.session import materialize


def tf_idf(matrix: DataFrame, n_rows: DataFrame, normalize: bool = True) -> DataFrame:
    """Counts times ln((1 + n) / (1 + df)) + 1, then rows of length 1.

    ``n_rows`` is one row (n): how many rows the matrix has, those without cells included.
    """
    df = matrix.filter("value <> 0").groupBy("col").agg(F.count("*").alias("df"))
    # One row of one number.
    idf = df.join(F.broadcast(n_rows), how="cross").select("col", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = matrix.join(idf, "col").select("row_id", "col", (F.col("value") * F.col("idf")).alias("value"))
    return coo.normalize_rows(weighted) if normalize else weighted


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("col").agg(F.sum("value").alias("score"))


def top_tokens(scores: DataFrame, vocab: DataFrame, text_limit: int | None, formula_limit: int | None) -> DataFrame:
    """(col, token, kind, score) of the best text and formula tokens; text tokens begin with ``t:``. None: no limit.

    Scores are compared at six decimals, ties in column order.
    """
    named = scores.join(vocab.select(F.col("idx").alias("col"), "token"), "col").withColumn("kind", F.when(F.col("token").startswith("t:"), "text").otherwise("formula"))
    named = named.withColumn("score", F.round("score", 6))
    kinds = [named.filter(F.col("kind") == kind) for kind in ("text", "formula")]
    # each partition keeps its own best first, so no task sees a whole vocabulary
    best = [k if n is None else k.orderBy(F.desc("score"), "col").limit(n) for k, n in zip(kinds, (text_limit, formula_limit))]
    return best[0].unionByName(best[1])


def balance(text: DataFrame, formula: DataFrame, rows: DataFrame) -> DataFrame:
    """The formula block scaled so that its average row is as long as that of the text block; unscaled if it is empty."""
    factor = coo.average_row_norm(text, rows).select(F.col("avg_norm").alias("t")).join(F.broadcast(coo.average_row_norm(formula, rows).select(F.col("avg_norm").alias("f"))), how="cross")
    return formula.join(F.broadcast(factor), how="cross").select("row_id", "col", F.when(F.col("f") > 0, F.col("value") * F.col("t") / F.col("f")).otherwise(F.col("value")).alias("value"))


@dataclass
class Processed:
    """A matrix (row_id, col, value) with its vocabulary (token, idx) and its rows (row_id and the item's key)."""

    matrix: DataFrame
    vocab: DataFrame
    rows: DataFrame


def raw_matrix(counts: DataFrame, items: DataFrame, keys: list[str], min_count: int) -> Processed:
    """Numbered rows for ``items`` (keys), a vocabulary of tokens with ``min_count`` occurrences, and the counts as a matrix."""
    counts = materialize(counts, "counts")  # texts are tokenised once, whatever is made of them
    vocab = coo.vocabulary(counts, least=min_count, count="n")
    rows = number_items(items.select(*keys).distinct(), keys)
    named = counts.join(rows, keys).select("row_id", "token", F.col("n").alias("value"))
    return Processed(materialize(coo.build(named, vocab), "matrix"), vocab, rows)


def number_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with ``row_id`` from 0 in the order of the keys, by range parts and prefix sums."""
    joined = items.withColumn("_key", F.concat_ws("\u0000", *(F.coalesce(k, F.lit("")) for k in keys)))
    return coo.dense_index(joined, "_key", "row_id", "long").drop("_key")


def processed_matrix(raw: Processed, text_limit: int | None = None, formula_limit: int | None = None) -> Processed:
    """Drops empty rows, keeps the best tokens by TF-IDF, balances the blocks and renumbers the columns.

    The values are raw counts; TF-IDF only chooses the columns.  Text columns come first.
    Without formula tokens only the text block is taken.
    """
    kept = materialize(coo.nonzero_rows(raw.matrix), "rows")
    matrix = coo.select_rows(raw.matrix, kept)
    weights = tf_idf(matrix, kept.agg(F.count("*").alias("n")))
    best = materialize(top_tokens(column_sums(weights), raw.vocab, text_limit, formula_limit).select("col", "token", "kind"), "best")
    order = best.withColumn("_key", F.concat(F.when(F.col("kind") == "text", "0").otherwise("1"), "token"))
    numbered = coo.dense_index(order, "_key", "new_col").select("col", "new_col", "token", "kind")
    cells = materialize(matrix.join(numbered, "col").select("row_id", F.col("new_col").alias("col"), "value", "kind"), "cells")
    text = cells.filter("kind = 'text'").drop("kind")
    formula = cells.filter("kind = 'formula'").drop("kind")
    return Processed(text.unionByName(balance(text, formula, kept)), numbered.select("token", F.col("new_col").alias("idx")), raw.rows.join(kept, "row_id", "left_semi"))


def normalized_blocks(text: DataFrame, formula: DataFrame, n_rows: DataFrame, text_width: int, height: int) -> DataFrame:
    """TF-IDF and unit rows for each block alone, then side by side."""
    return coo.append_columns(tf_idf(text, n_rows), tf_idf(formula, n_rows), text_width, height, height)
