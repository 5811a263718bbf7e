"""Sparse matrices in long format: rows (row_id, col, value), one for each non-zero cell.

Rows that hold nothing have no cell.  Where they matter - an average over all
rows, a distance to a row without overlap - an operator takes the table of row
ids beside the matrix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mathquarry.session import materialize


def vocabulary(tokens: DataFrame, token: str = "token", least: int = 1, count: str | None = None) -> DataFrame:
    """(token, idx): the tokens that occur ``least`` times, numbered from 0 in the order of their bytes.

    With ``count`` the input is counted already.  The numbers come from a range
    partitioning and the sizes of its parts, so no task sees all tokens.
    """
    counts = tokens.groupBy(F.col(token).alias("token")).agg((F.sum(count) if count else F.count("*")).alias("n"))
    return dense_index(counts.filter(F.col("n") >= least).select("token"), "token", "idx")


def dense_index(df: DataFrame, key: str, name: str, kind: str = "int") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 .. in the order of ``key``, which must not repeat.

    Rows are range-partitioned and sorted, numbered within their partition and stored;
    the number of rows in the partitions before, one number per partition, is added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(own) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, (own + F.col("_before")).cast(kind)).drop("_at", "_part", "_before")


def build(counts: DataFrame, vocab: DataFrame | None = None, columns: int | None = None) -> DataFrame:
    """A matrix from feature counts (row_id, token, value): by vocabulary, which drops unknown tokens, or by column number.

    Exactly one of the two must be given; ``columns`` means that ``token`` is the number already.
    """
    if (vocab is None) == (columns is None):
        raise ValueError("exactly one of vocab and columns must be given")
    if vocab is None:
        return counts.select("row_id", F.col("token").cast("int").alias("col"), F.col("value").cast("double").alias("value")).filter((F.col("col") >= 0) & (F.col("col") < columns))
    return counts.join(vocab, "token").select("row_id", F.col("idx").alias("col"), F.col("value").cast("double").alias("value"))


def select_columns(matrix: DataFrame, selected: DataFrame) -> DataFrame:
    """The columns of ``selected`` (col, new_col), under their new numbers."""
    return matrix.join(selected, "col").select("row_id", F.col("new_col").alias("col"), "value")


def select_rows(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (row_id)."""
    return matrix.join(rows.select("row_id"), "row_id", "left_semi")


def project_reindex(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """The columns of ``features`` (col), numbered from 0 in ascending order."""
    return select_columns(matrix, dense_index(features.select("col").distinct(), "col", "new_col"))


def nonzero_rows(matrix: DataFrame) -> DataFrame:
    """(row_id) of the rows whose sum isn't zero."""
    return matrix.groupBy("row_id").agg(F.sum("value").alias("s")).filter("s <> 0").select("row_id")


def scale(matrix: DataFrame, factor: float | Column) -> DataFrame:
    return matrix.withColumn("value", F.col("value") * factor)


def stack_rows(first: DataFrame, second: DataFrame, height: int, width: int, other_width: int) -> DataFrame:
    """``second`` below ``first``, which has ``height`` rows; both must be equally wide."""
    if width != other_width:
        raise ValueError("matrices of different widths can't be stacked")
    return first.unionByName(second.withColumn("row_id", F.col("row_id") + F.lit(height)))


def append_columns(first: DataFrame, second: DataFrame, width: int, height: int, other_height: int) -> DataFrame:
    """``second`` to the right of ``first``, which has ``width`` columns; both must have as many rows."""
    if height != other_height:
        raise ValueError("matrices of different heights can't be put side by side")
    return first.unionByName(second.withColumn("col", (F.col("col") + F.lit(width)).cast("int")))


def row_norms(matrix: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, norm); rows of ``rows`` without cells have norm 0."""
    norms = matrix.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return norms if rows is None else rows.select("row_id").join(norms, "row_id", "left").select("row_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def average_row_norm(matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (avg_norm); rows without cells count as 0. No rows: NULL."""
    return row_norms(matrix, rows).agg(F.avg("norm").alias("avg_norm"))


def normalize_rows(matrix: DataFrame) -> DataFrame:
    """Rows of length 1; rows of length 0 stay as they are."""
    norms = matrix.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return matrix.join(norms, "row_id").select("row_id", "col", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.col("value")).alias("value"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row_id"), F.col("row_id").alias("col"), "value")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product: joined on the shared index, products added up."""
    right = b.select(F.col("row_id").alias("col"), F.col("col").alias("other"), F.col("value").alias("factor"))
    return a.join(right, "col").groupBy("row_id", F.col("other").alias("col")).agg(F.sum(F.col("value") * F.col("factor")).alias("value"))


def sum_rows_by(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows added up by group: ``groups`` has (row_id, group)."""
    return matrix.join(groups, "row_id").groupBy(F.col("group").alias("row_id"), "col").agg(F.sum("value").alias("value"))


def token_weights(matrix: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, weights): each row as a map token -> weight."""
    named = matrix.join(vocab.select(F.col("idx").alias("col"), "token"), "col")
    return named.groupBy("row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "value")))).alias("weights"))


def to_vectors(matrix: DataFrame, width: int) -> DataFrame:
    """(row_id, features): sparse vectors for models, made in Arrow batches; a row's cells fit in memory, being a vector."""
    from pyspark.ml.linalg import VectorUDT

    @F.pandas_udf(VectorUDT())
    def make(cols: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"type": 0, "size": width, "indices": cols, "values": values})  # how a sparse vector is stored

    cells = matrix.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    return cells.select("row_id", make(F.col("cells.col"), F.col("cells.value")).alias("features"))


def from_vectors(vectors: DataFrame) -> DataFrame:
    """The matrix of (row_id, features) again, without zeros."""
    from pyspark.ml.functions import vector_to_array

    return vectors.select("row_id", F.posexplode(vector_to_array("features")).alias("col", "value")).filter("value <> 0")


def indexes_in(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos) of the items (pos, item) that are in ``wanted`` (item)."""
    return items.join(wanted.select("item").distinct(), "item", "left_semi").select("pos")
