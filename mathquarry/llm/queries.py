"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry.llm import cluster, encode, names, neardup, ngrams, pack, split, sql, words
from mathquarry.session import distinct_records, materialize, table

#: Parameters of production.
TYPICAL = 5
RARE_RECORDS, COMMON_SHARE, NGRAM_LENGTH = 3, 10, 3
CAPACITY = 2048
PIECE_LIMIT, PIECE_OVERLAP = 512, 64


def _clusters(spark: SparkSession, sf_dir: str):
    vectors = cluster.vectors_of(table(spark, sf_dir, "paragraph2"), "document", "paragraph_id")
    return vectors, cluster.bisect(vectors)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, tree = _clusters(spark, sf_dir)
    if not tree.leaves():
        return vectors.select("document", "paragraph_id", F.lit(0).alias("exemplar_id")).limit(0)
    examples = {r["exemplar_id"]: r["text"] for r in table(spark, sf_dir, "exemplar").collect()}  # a fixed table of 19 rows
    return cluster.belongs(vectors, tree, cluster.subjects(tree, examples))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaf: its size, compactness, spread over the main classes and most typical paragraphs."""
    vectors, tree = _clusters(spark, sf_dir)
    assigned = materialize(cluster.assign(vectors, tree), "assigned")
    main = distinct_records(table(spark, sf_dir, "document").select("id", "main_msc_cat", "loaded_at")).groupBy("id").agg(F.min("main_msc_cat").alias("main"))
    spread = assigned.join(main, F.col("document") == F.col("id"), "left").groupBy("cluster", F.coalesce("main", F.lit("none")).alias("main")).agg(F.count("*").alias("n"))
    classes = spread.groupBy("cluster").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "main"))).alias("c"))
    classes = classes.select("cluster", "size", F.transform("c", lambda x: F.concat(x["main"], F.lit(":"), (-x["minus"]).cast("string"))).alias("classes"))
    typical = cluster.nearest(assigned, TYPICAL, "document", "paragraph_id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("|", "document", "paragraph_id").alias("key")))).alias("t"))
    compact = assigned.groupBy("cluster").agg(F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    return classes.join(typical, "cluster").join(compact, "cluster").select("cluster", "size", "mean_cosine", "classes", F.col("t")["key"].alias("typical"))


def _term_tables(spark: SparkSession, sf_dir: str):
    """The fields of problem 2: name, one text of each record, how it is cut into terms."""
    for name, column, key, terms_of in (("theorem", "text", ["document", "paragraph_id"], words.words), ("formula", "c_math_ml", ["document", "formula_id"], words.content_terms)):
        records = distinct_records(table(spark, sf_dir, name).select(*key, column))
        yield f"{name}.{column}", records.select(column), terms_of


def _marked(spark: SparkSession, sf_dir: str, longest: int) -> DataFrame:
    """The n-grams of up to ``longest`` terms of both fields, with the mark of those too rare or too common; always from the suffixes of NGRAM_LENGTH terms."""
    parts = [ngrams.ngram_counts(texts, terms_of, NGRAM_LENGTH, longest).withColumn("field", F.lit(field)) for field, texts, terms_of in _term_tables(spark, sf_dir)]
    counts = parts[0].unionByName(parts[1])
    totals = {r["field"]: r["n"] for r in counts.filter("n_terms = 0").groupBy("field").agg(F.sum("n_records").alias("n")).collect()}  # two rows
    total = F.lit(None).cast("long")
    for field, n in totals.items():
        total = F.when(F.col("field") == field, F.lit(n)).otherwise(total)
    mark = F.when(F.col("n_records") < RARE_RECORDS, "rare").when(F.col("n_records") * COMMON_SHARE > total, "common")
    return counts.filter("n_terms > 0").withColumn("mark", mark)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir, 1).filter("mark is not null").select("field", F.col("ngram").alias("term"), "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-gram of up to three terms with its frequencies and mark."""
    return _marked(spark, sf_dir, NGRAM_LENGTH).select("field", F.translate("ngram", ngrams.MARK, " ").alias("ngram"), "n_terms", "n_occurrences", "n_records", "mark")


def _links(spark: SparkSession, sf_dir: str, typed: DataFrame) -> DataFrame:
    profiles = table(spark, sf_dir, "author_profile").select(F.col("zbmath_id").alias("id"), F.col("preferred_name").alias("preferred"))
    return names.link_names(typed.select(F.col("display_name").alias("name")), profiles)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_rows = table(spark, sf_dir, "authorship").filter("zbmath_id is null or trim(zbmath_id) = ''").select("document", "rank", "display_name").distinct()
    links = _links(spark, sf_dir, open_rows)
    return open_rows.join(links, F.col("display_name") == F.col("name")).select("document", "rank", F.col("id").alias("zbmath_id")).distinct()


def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling that is linked, with how many records have it and how far it is from the name."""
    rows = table(spark, sf_dir, "authorship").select("document", "rank", "display_name").distinct()
    counts = rows.groupBy("display_name").agg(F.count("*").alias("n_records"))
    return counts.join(_links(spark, sf_dir, rows), F.col("display_name") == F.col("name")).select("display_name", F.col("id").alias("zbmath_id"), "cost", "n_records")


def _restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    theorem, document = table(spark, sf_dir, "theorem"), table(spark, sf_dir, "document")
    keyed = theorem.select(F.lit("theorem.text").alias("field"), F.concat_ws("|", F.coalesce("document", F.lit("")), F.coalesce("paragraph_id", F.lit(""))).alias("key"), "text")
    return neardup.word_sets(keyed.unionByName(document.select(F.lit("document.title").alias("field"), F.col("id").alias("key"), F.col("title").alias("text"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.record_pairs(_restated(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with words: its class of equal word sets, its group and its number of links."""
    return neardup.groups(_restated(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = materialize(encode.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")), "lengths")
    return pack.pack(lengths, CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    per = p7_packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_items"))
    return per.agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"),
        F.sum(F.lit(CAPACITY) - F.col("n_tokens")).alias("unused"), F.round(F.sum("n_tokens") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_LIMIT, PIECE_OVERLAP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_terms": p2_terms, "p3_found": p3_found, "p3_variants": p3_variants, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_pieces": p8_pieces}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force, round trips and the cases of the task."""
    return {
        "p2_found": sql.ngrams(1, RARE_RECORDS, COMMON_SHARE) + "SELECT field, ngram AS term, mark FROM marked WHERE mark IS NOT NULL",
        "p2_terms": sql.ngrams(NGRAM_LENGTH, RARE_RECORDS, COMMON_SHARE) + "SELECT field, ngram, n_terms, n_occurrences, n_records, mark FROM marked",
        "p5_found": sql.near_duplicates(),
    }
