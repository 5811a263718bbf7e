"""Token rows from texts and formulas, and their counts per record, document and corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mathquarry.functions import formula, text
from mathquarry.functions.text import identity
from mathquarry.session import bounded, distinct_records, materialize

KEY = ["document", "paragraph_id"]


def count_by(df: DataFrame, value: str | Column) -> DataFrame:
    """(value, n): how often each value occurs."""
    return df.groupBy((F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count("*").alias("n"))


def add_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two count tables (value, n) added."""
    return first.unionByName(second).groupBy("value").agg(F.sum("n").alias("n"))


def paragraph_source(theorem: DataFrame, paragraph2: DataFrame, data_basis: str) -> DataFrame:
    """The distinct paragraphs (document, paragraph_id, text) of the data basis: theorems, or full text."""
    source = {"only_theorems": theorem, "full_text": paragraph2}[data_basis]
    return distinct_records(source.select(*KEY, "text"))


def word_rows(paragraphs: DataFrame, lemmatize=identity, prefix: str = "") -> DataFrame:
    """(document, paragraph_id, pos, token): a row for each word of each paragraph."""
    return paragraphs.select(*KEY, F.posexplode(text.word_tokens(F.col("text"), prefix, lemmatize)).alias("pos", "token"))


def mixed_rows(paragraphs: DataFrame, formulas: DataFrame, method: str, lemmatize=identity) -> DataFrame:
    """(document, paragraph_id, part_pos, token_pos, token): words as ``t:`` tokens and, unless the method is
    plaintext, the features of the formulas that are cited; references to unknown formulas give none."""
    if method not in ("plaintext", "kristianto", "lin"):
        raise ValueError(f"unknown method {method!r}")
    parts = paragraphs.select(*KEY, F.explode(text.mixed_parts(F.col("text"))).alias("part"))
    passages = parts.filter("part.kind = 'text'").select(*KEY, "part.part_pos", F.posexplode(text.word_tokens(F.col("part.value"), "t:", lemmatize)).alias("token_pos", "token"))
    if method == "plaintext":
        return passages
    cited = parts.filter("part.kind = 'formula'").select(*KEY, "part.part_pos", F.col("part.value").alias("formula_id"))
    # Only formulas that something cites are parsed, each once.
    used = formulas.select("document", "formula_id", "c_math_ml").distinct().join(cited.select("document", "formula_id").distinct(), ["document", "formula_id"], "left_semi")
    features = formula.formula_tokens(used, method)
    found = cited.join(features, ["document", "formula_id"])
    return passages.unionByName(found.select(*KEY, "part_pos", F.posexplode("tokens").alias("token_pos", "token")))


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n_occurrences, n_documents) over the corpus."""
    per = rows.groupBy("document", "token").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_documents"))


def item_counts(rows: DataFrame, granularity: str = "documents", mode: str = "tf") -> DataFrame:
    """(document[, paragraph_id], token, n): counts per item.

    ``mode``: ``tf`` counts occurrences; ``reference`` gives 1 for every token of a document, which
    is what counting the keys of a document's map comes to (paragraphs always count occurrences).
    """
    if mode not in ("tf", "reference"):
        raise ValueError(mode)
    keys = ["document"] if granularity == "documents" else KEY
    n = F.lit(1).cast("long") if mode == "reference" and granularity == "documents" else F.count("*")
    return rows.groupBy(*keys, "token").agg(n.alias("n"))


def document_tokens(paragraphs: DataFrame, lemmatize=identity) -> DataFrame:
    """(document, paragraph_id, at, tokens): the token list of each document in pieces, a paragraph's words and the place of the first in the list.

    Paragraphs follow in the order of their ids, those of one id in the order of their words.
    However long a document is, no task holds more of its list than a part of the rows: places are
    sums over range parts of the rows, added up like the numbers of a dense index.
    """
    per = paragraphs.select("document", "paragraph_id", text.word_tokens(F.col("text"), "", lemmatize).alias("tokens"))
    return running_total(per, "document", ["paragraph_id", "tokens"], F.size("tokens"), "at")


def running_total(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key before each row.

    Rows are range-partitioned by key and order, so a hot key is spread; sums of the parts before
    are one number for each key and part.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.withColumn("_v", value.cast("long")).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = W.partitionBy("_part", key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(key, "_part").agg(F.sum("_v").alias("_s"))
    before = parts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = placed.withColumn("_own", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    joined = running.join(before, running[key].eqNullSafe(before["_k"]) & (running["_part"] == before["_p"]))
    return joined.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def document_token_list(paragraphs: DataFrame, lemmatize=identity, most: int = 100_000) -> DataFrame:
    """(document, tokens): the list in one row, for documents of at most ``most`` paragraphs; fails on a larger one, for which ``document_tokens`` is."""
    per = paragraphs.select("document", "paragraph_id", text.word_tokens(F.col("text"), "", lemmatize).alias("tokens"))
    checked = bounded(per, "document", most)
    return checked.groupBy("document").agg(F.flatten(F.array_sort(F.collect_list(F.struct("paragraph_id", "tokens"))).getField("tokens")).alias("tokens"))


def theorem_word_counts(paragraphs: DataFrame) -> DataFrame:
    """(document, token, n) of the words of theorem paragraphs, references left out."""
    theorems = paragraphs.filter(F.col("paragraph_id").contains("thm"))
    tokens = F.explode(F.flatten(F.transform(text.sentences(F.col("text")), lambda s: text.sentence_parts(s, keep_references=False)))).alias("token")
    return theorems.select("document", tokens).groupBy("document", "token").agg(F.count("*").alias("n"))


def formula_feature_counts(formulas: DataFrame, method: str = "content", only_theorems: bool = False, ignore_numbers: bool = False) -> DataFrame:
    """(document, token, n): features of a document's formulas added up."""
    records = distinct_records(formulas.select("document", "formula_id", "c_math_ml"))
    if only_theorems:
        records = records.filter(F.lower("formula_id").contains("thm"))
    tokens = formula.formula_tokens(records, method).select("document", F.explode("tokens").alias("token"))
    if ignore_numbers:
        tokens = tokens.filter(formula.without_numbers(F.col("token")))
    return tokens.groupBy("document", "token").agg(F.count("*").alias("n"))


def cited_formula_counts(paragraphs: DataFrame, formulas: DataFrame, method: str = "content") -> DataFrame:
    """(document, paragraph_id, token, n): features of the formulas each paragraph cites."""
    rows = mixed_rows(paragraphs, formulas, method) if method != "content" else _cited_content(paragraphs, formulas)
    return rows.filter(~F.col("token").startswith("t:")).groupBy(*KEY, "token").agg(F.count("*").alias("n"))


def _cited_content(paragraphs: DataFrame, formulas: DataFrame) -> DataFrame:
    parts = paragraphs.select(*KEY, F.explode(text.mixed_parts(F.col("text"))).alias("part")).filter("part.kind = 'formula'").select(*KEY, F.col("part.value").alias("formula_id"))
    features = formula.formula_tokens(formulas.select("document", "formula_id", "c_math_ml").distinct(), "content")
    return parts.join(features, ["document", "formula_id"]).select(*KEY, F.explode("tokens").alias("token"))


def sourced_word_counts(articles: DataFrame, source: str = "zbmath metadata") -> DataFrame:
    """(token, n) over the articles (included_sources, tokens) that have a source."""
    rows = articles.filter(F.array_contains("included_sources", source)).select(F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def merge_features(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two feature tables (document, token, n) of the same documents; fails on a document that one lacks or a token both have."""
    a, b = first.withColumn("side", F.lit(1)), second.withColumn("side", F.lit(2))
    both = a.unionByName(b)
    docs = both.groupBy("document").agg(F.bit_or("side").alias("sides"))
    checked = both.groupBy("document", "token").agg(F.sum("n").alias("n"), F.bit_or("side").alias("s")).join(docs, "document")
    fine = F.assert_true((F.col("s") < 3) & (F.col("sides") == 3), "feature tables must have the same documents and no common token")
    return checked.filter(fine.isNull()).select("document", "token", "n")


def mentions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(token, n): how often the words of a list (token) occur among ``rows`` (token)."""
    counted = rows.groupBy("token").agg(F.count("*").alias("n"))
    return counted.join(names.select("token").distinct(), "token", "left_semi")


def top_n_per_key(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with ``place`` from 1."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("place") <= n)


def cooccurrences(rows: DataFrame, window: int = 10) -> DataFrame:
    """(token, other, weight): for each pair of words at most ``window`` apart in a paragraph the sum of 1 / distance.

    The words after each word come from window functions, so no paragraph is joined with itself.
    """
    w = W.partitionBy(*KEY).orderBy("pos")
    gaps = range(1, window + 1)
    ahead = rows.select("token", *(F.lead("token", i).over(w).alias(f"a{i}") for i in gaps))
    near = F.inline(F.array(*(F.struct(F.lit(i).alias("gap"), F.col(f"a{i}").alias("other")) for i in gaps)))
    pairs = ahead.select("token", near).filter("other is not null")
    # distances are whole numbers, so sums are exact until the end
    per = pairs.groupBy("token", "other").agg(*(F.count(F.when(F.col("gap") == i, 1)).alias(f"n{i}") for i in range(1, window + 1)))
    return per.select("token", "other", sum((F.col(f"n{i}") / i for i in range(2, window + 1)), F.col("n1").cast("double")).alias("weight"))
