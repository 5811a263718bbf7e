"""Authors: classes, similarity, incidence with items, and propagation through topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mathquarry.operators import coo
from mathquarry.session import bounded

# The two-character classes of the subject classification, in their order.
MSC_CLASSES = (
    "00 01 03 05 06 08 11 12 13 14 15 16 17 18 19 20 22 26 28 30 31 32 33 34 35 37 39 40 41 42 43 44 45 46 47 49 51 52 53 54 55 57 58 60 62 65 67 68 70 74 76 78 80 81 82 83 85 86 90 91 92 93 94 97"
).split()

# The classes most articles have, in their order.
FREQUENT_CLASSES = "05 11 14 17 20 35 37 46 53 57 60 68 81 82".split()


class NoSuchAuthor(ValueError):
    pass


class AmbiguousAuthor(ValueError):
    pass


def author_msc_counts(authorship: DataFrame, msc: DataFrame, max_rank: int = 2, max_pos: int = 3) -> DataFrame:
    """(author, class, n): how often an author's articles are assigned each two-character class.

    The first ``max_rank`` authors and ``max_pos`` codes of an article count; blank names
    and classes that aren't known are left out.
    """
    a = authorship.filter(F.col("rank") <= max_rank).filter("trim(display_name) <> ''").select("document", F.col("display_name").alias("author"))
    m = msc.filter(F.col("pos") <= max_pos).select("document", F.substring(F.trim("msc"), 1, 2).alias("class")).filter(F.col("class").isin(MSC_CLASSES))
    # Codes are summed up per article first: an article of many authors and codes isn't multiplied out twice.
    per = m.groupBy("document", "class").agg(F.count("*").alias("n"))
    return a.join(per, "document").groupBy("author", "class").agg(F.sum("n").alias("n"))


def find_author(counts: DataFrame, author: str) -> None:
    """Raises NoSuchAuthor or AmbiguousAuthor unless exactly one author has the name."""
    n = counts.filter(F.col("author") == author).select("author").distinct().count()
    if n == 0:
        raise NoSuchAuthor(author)


def similar_authors(counts: DataFrame, author: str | DataFrame, top_n: int = 20, metric: str = "cosine") -> DataFrame:
    """(author, distance) of the ``top_n`` authors nearest to one, who is at distance 0; ties by name.

    ``author`` is a name or one row (author).  Authors without a common class have cosine distance 1.
    """
    query = author if isinstance(author, DataFrame) else counts.sparkSession.createDataFrame([(author,)], "author string")
    mine = counts.join(F.broadcast(query), "author").select("class", F.col("n").alias("m"))  # one author: at most as many rows as classes
    both = counts.join(F.broadcast(mine), "class", "left")
    x, y = F.col("n").cast("double"), F.coalesce("m", F.lit(0)).cast("double")
    own = mine.agg(F.sum(F.col("m") * F.col("m")).cast("double").alias("q"), F.sum("m").cast("double").alias("s"))
    per = both.groupBy("author").agg(F.sum(x * y).alias("dot"), F.sum(x * x).alias("nn"), F.sum(F.when(F.col("m").isNotNull(), F.col("m") * F.col("m")).otherwise(0)).cast("double").alias("seen"), F.sum(F.abs(x - y)).alias("l1"), F.sum(y).alias("seen1"))
    joined = per.join(F.broadcast(own), how="cross")  # one row
    distance = {
        "cosine": 1 - F.col("dot") / F.sqrt(F.col("nn") * F.col("q")),
        "euclidean": F.sqrt(F.greatest(F.col("nn") - 2 * F.col("dot") + F.col("q"), F.lit(0.0))),
        "cityblock": F.col("l1") + F.col("s") - F.col("seen1"),
    }[metric]
    return joined.select("author", F.round(distance, 6).alias("distance")).orderBy("distance", "author").limit(top_n)


def ids_with_authors(items: DataFrame, authorship: DataFrame, keys: list[str], max_rank: int = 2) -> DataFrame:
    """(keys, line): ``key;Name(id);..``, padded with ``;`` to ``max_rank`` authors; items without authors are kept."""
    ranked = authorship.filter(F.col("rank") <= max_rank).select("document", "rank", F.concat("display_name", F.lit("("), F.coalesce("zbmath_id", F.lit("None")), F.lit(")")).alias("a"))
    names = ranked.filter("a is not null").groupBy("document").agg(F.array_sort(F.collect_list(F.struct("rank", "a"))).getField("a").alias("names"))
    joined = items.join(names, "document", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    padding = F.repeat(F.lit(";"), F.greatest(F.lit(max_rank) - F.size("names"), F.lit(0)))
    return joined.select(*keys, F.concat(F.concat_ws(";", *keys), F.lit(";"), F.array_join("names", ";"), padding).alias("line"))


def author_items(rows: DataFrame, authorship: DataFrame, max_rank: int = 2) -> DataFrame:
    """(author, row_id, value): 1.0 for each author and item (row_id, document); blank names are left out."""
    a = authorship.filter(F.col("rank") <= max_rank).filter("trim(display_name) <> ''").select("document", F.col("display_name").alias("author"))
    return rows.select("row_id", "document").join(a, "document").select("author", "row_id").distinct().withColumn("value", F.lit(1.0))


def author_item_maps(pairs: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Items of each author, and authors of each item, as sorted arrays; fails on one with more than ``most``, for which the pairs themselves serve."""
    pairs = pairs.select("author", "row_id").distinct()
    return (
        bounded(pairs, "author", most).groupBy("author").agg(F.array_sort(F.collect_list("row_id")).alias("items")),
        bounded(pairs, "row_id", most).groupBy("row_id").agg(F.array_sort(F.collect_list("author")).alias("authors")),
    )


def topic_scores(pairs: DataFrame, topics: DataFrame, author: str | DataFrame) -> DataFrame:
    """(author, score) of all authors by the chain author, items, topics, items, authors with unit rows throughout.

    pairs: (author, row_id, value); topics: (row_id, topic, weight).  The chain starts from one
    author, so each step joins few rows with many.
    """
    query = author if isinstance(author, DataFrame) else pairs.sparkSession.createDataFrame([(author,)], "author string")
    a = coo.normalize_rows(pairs.select(F.col("author").alias("row_id"), F.col("row_id").alias("col"), "value")).select(F.col("row_id").alias("author"), F.col("col").alias("row_id"), "value")
    t = coo.normalize_rows(topics.select("row_id", F.col("topic").alias("col"), F.col("weight").alias("value"))).select("row_id", F.col("col").alias("topic"), F.col("value").alias("weight"))
    mine = a.join(F.broadcast(query), "author")
    by_topic = mine.join(t, "row_id").groupBy("topic").agg(F.sum(F.col("value") * F.col("weight")).alias("mass"))
    by_item = t.join(by_topic, "topic").groupBy("row_id").agg(F.sum(F.col("weight") * F.col("mass")).alias("score"))
    return a.join(by_item, "row_id").groupBy("author").agg(F.sum(F.col("value") * F.col("score")).alias("score"))


def author_walk(pairs: DataFrame, topics: DataFrame, author: str | DataFrame) -> DataFrame:
    """(author, mass): a walk from one author's items in equal parts to topics, from topics to items by their
    share of the topic, from items in equal parts to authors.

    Items without authors hold nothing back: shares are over items that have authors, so the
    mass adds up to 1 if each item's topic weights do.
    """
    query = author if isinstance(author, DataFrame) else pairs.sparkSession.createDataFrame([(author,)], "author string")
    mine = pairs.join(F.broadcast(query), "author").select("row_id", (F.lit(1.0) / F.count("*").over(W.partitionBy())).alias("part"))
    by_topic = mine.join(topics, "row_id").groupBy("topic").agg(F.sum(F.col("part") * F.col("weight")).alias("mass"))
    known = topics.join(pairs.select("row_id").distinct(), "row_id", "left_semi")
    totals = known.groupBy("topic").agg(F.sum("weight").alias("total")).filter("total > 0")
    shares = known.join(totals.join(by_topic, "topic"), "topic").groupBy("row_id").agg(F.sum(F.col("weight") / F.col("total") * F.col("mass")).alias("mass"))
    counts = pairs.groupBy("row_id").agg(F.count("*").alias("n"))
    return pairs.join(shares.join(counts, "row_id"), "row_id").groupBy("author").agg(F.sum(F.col("mass") / F.col("n")).alias("mass"))


def best_authors(scores: DataFrame, score: str, n: int = 20) -> DataFrame:
    """The ``n`` authors with the highest score at six decimals, ties by name."""
    return scores.select("author", F.round(score, 6).alias(score)).orderBy(F.desc(score), "author").limit(n)
