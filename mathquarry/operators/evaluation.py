"""Interpretation of clusters and classes: overlap, chi-square, rank correlation, quality, histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathquarry.session import bounded


def overlap(clusters: DataFrame, categories: DataFrame) -> DataFrame:
    """(cluster, category, n_common, jaccard, share_of_cluster, share_of_category) for every cluster and category.

    clusters: (doc_id, cluster); categories: (doc_id, category).  Sizes of unions come
    from counts; pairs without common documents are kept with zeros.
    """
    a, b = clusters.distinct(), categories.distinct()
    n_a, n_b = a.groupBy("cluster").agg(F.count("*").alias("na")), b.groupBy("category").agg(F.count("*").alias("nb"))
    common = a.join(b, "doc_id").groupBy("cluster", "category").agg(F.count("*").alias("i"))
    # One row for each pair of names: the result itself.
    pairs = n_a.join(n_b, how="cross").join(common, ["cluster", "category"], "left").withColumn("i", F.coalesce("i", F.lit(0)))
    return pairs.select(
        "cluster", "category", F.col("i").cast("long").alias("n_common"), (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"),
        (F.col("i") / F.col("na")).alias("share_of_cluster"), (F.col("i") / F.col("nb")).alias("share_of_category"),
    )


def cluster_shares(clusters: DataFrame) -> DataFrame:
    """(cluster, n, share): sizes and shares of the total at four decimals."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.select("cluster", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("share"))


def group_members(members: DataFrame, group: str, member: str = "doc_id") -> DataFrame:
    """(group, member): each group's members once, in rows, however large the group is."""
    return members.select(group, member).distinct()


def group_sets(members: DataFrame, group: str, member: str = "doc_id", most: int | None = None) -> DataFrame:
    """(group, members): the sorted set of each group's members, however many; with ``most`` it fails on a larger group.

    Members are range-partitioned, so a large group is spread and sorted in pieces; only its pieces meet, as
    plain arrays that follow one another. The result holds a group in one row, which Spark limits to 2 GB.
    """
    each = group_members(members, group, member)
    if most is not None:
        each = bounded(each, group, most)
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = each.repartitionByRange(n, group, member).withColumn("_part", F.spark_partition_id())
    pieces = placed.groupBy(group, "_part").agg(F.sort_array(F.collect_list(member)).alias("_piece"))
    return pieces.groupBy(group).agg(F.flatten(F.sort_array(F.collect_list(F.struct("_part", "_piece"))).getField("_piece")).alias("members"))


def percent(part, total):
    """Whole percent, rounded down."""
    return F.floor(100 * part / total).cast("long")


def best_overlap(pairs: DataFrame) -> DataFrame:
    """(category, jaccard): the largest of each category."""
    return pairs.groupBy("category").agg(F.max("jaccard").alias("jaccard"))


def main_class(classes) -> F.Column:
    """Two-character prefix of the first class; NULL without classes."""
    return F.substring(F.try_element_at(classes, F.lit(1)), 1, 2)


def class_members(items: DataFrame, all_classes: bool = True) -> DataFrame:
    """(doc_id, category) of items (doc_id, classes): of all classes or of the first; items without classes are dropped."""
    prefix = F.explode(F.array_distinct(F.transform("classes", lambda c: F.substring(c, 1, 2)))) if all_classes else main_class(F.col("classes"))
    return items.select("doc_id", prefix.alias("category")).filter("category is not null")


def prefix_label(code, target: str):
    """1 if the code begins with the target, 0 if not, NULL if it is unknown."""
    return F.when(code.isNull(), F.lit(None)).otherwise(code.startswith(target).cast("int"))


# ---------------------------------------------------------------- chi-square


@F.pandas_udf(T.DoubleType())
def chi2_p(score: pd.Series) -> pd.Series:
    """Probability of a larger chi-square with one degree of freedom."""
    return score.map(lambda x: None if x is None or x != x else math.erfc(math.sqrt(max(x, 0) / 2)))


def chi2_scores(matrix: DataFrame, labels: DataFrame, with_p: bool = False) -> DataFrame:
    """(class, col, score[, p]) of every class and column.

    labels: (row_id, class), a row may have several.  The statistic compares the
    sum of a column in the class with what its share of the labelled rows would
    give, and likewise outside.  Columns of no sum and classes of all rows have none.
    """
    rows = labels.select("row_id").distinct()
    cells = matrix.join(rows, "row_id", "left_semi")
    totals = cells.groupBy("col").agg(F.sum("value").alias("f")).filter("f <> 0")
    sizes = labels.groupBy("class").agg(F.count("*").alias("k"))
    n = rows.agg(F.count("*").alias("n"))
    inside = cells.join(labels, "row_id").groupBy("class", "col").agg(F.sum("value").alias("o"))
    # Every class scores every column, whether it occurs there or not: the result itself.
    grid = totals.join(sizes.join(F.broadcast(n), how="cross"), how="cross").join(inside, ["class", "col"], "left")
    p = F.col("k") / F.col("n")
    off = F.coalesce("o", F.lit(0.0)) - p * F.col("f")
    out = grid.filter("k < n").select("class", "col", (off * off / (F.col("f") * p * (1 - p))).alias("score"))
    return out.withColumn("p", chi2_p("score")) if with_p else out


def chi2_top(scores: DataFrame, n: int = 1000) -> DataFrame:
    """The best ``n`` columns of each class with their place; compared at six decimals, ties in column order."""
    rounded = scores.withColumn("score", F.round("score", 6))
    return rounded.withColumn("place", F.row_number().over(W.partitionBy("class").orderBy(F.desc("score"), "col"))).filter(F.col("place") <= n)


def chi2_terms(scores: DataFrame, vocab: DataFrame, threshold: float) -> DataFrame:
    """(class, token, score) above the threshold."""
    return scores.filter(F.col("score") > threshold).join(vocab.select(F.col("idx").alias("col"), "token"), "col").select("class", "token", "score")


def chi2_columns(scores: DataFrame, threshold: float) -> DataFrame:
    """(col) of the columns above the threshold in any class."""
    return scores.filter(F.col("score") > threshold).select("col").distinct()


# ---------------------------------------------------------------- rank correlation


def align(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """(on, x, y): two lists (on, value) over the union of their terms, missing values 0."""
    a, b = first.select(*on, F.col("value").alias("x")), second.select(*on, F.col("value").alias("y"))
    return a.join(b, on, "full").select(*on, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def spearman(aligned: DataFrame, by: list[str]) -> DataFrame:
    """(by, rho, n): correlation of average ranks within each group; NULL where one side is constant."""
    average = lambda c: F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2
    ranked = aligned.select(*by, average("x").alias("rx"), average("y").alias("ry"))
    rho = F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    return ranked.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided probability of a correlation as large without dependence, by Student's distribution with n - 2 degrees."""

    def one(r, k):
        if r is None or r != r or k < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        t, df = abs(r) * math.sqrt((k - 2) / (1 - r * r)), k - 2
        return _beta_tail(df / (df + t * t), df / 2, 0.5)

    return pd.Series([one(r, k) for r, k in zip(rho, n)])


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + k * d
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1 + k / (c if abs(c) > 1e-300 else 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


# ---------------------------------------------------------------- classification quality


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f1) of (label, prediction) in {0, 1}; NULL where nothing is counted.

    Rows without a label are left out.
    """
    known = predicted.filter("label is not null and prediction is not null")
    n = lambda a, b: F.count(F.when((F.col("label") == a) & (F.col("prediction") == b), 1))
    counts = known.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b > 0, a / b)
    with_pr = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return with_pr.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


# ---------------------------------------------------------------- histograms


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = (), keep_empty: bool = True) -> DataFrame:
    """(by, bin, label, n): values in [bound, next bound), bins from 0; others are dropped.

    Labels are the lower bound, or ``lower - upper`` for bins wider than 1.  Empty
    bins are zero-filled unless ``keep_empty`` is off.
    """
    bins = list(zip(bounds, bounds[1:]))
    labels = [f"{lo:g}" if hi - lo == 1 else f"{lo:g} - {hi - 1:g}" for lo, hi in bins]
    counts = df.groupBy(*by).agg(*(F.count(F.when((F.col(value) >= lo) & (F.col(value) < hi), 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(bins)))
    rows = F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(labels[i]).alias("label"), F.col(f"b{i}").alias("n")) for i in range(len(bins))))
    out = counts.select(*by, F.inline(rows))
    return out if keep_empty else out.filter("n > 0")
