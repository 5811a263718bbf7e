"""Readers and writers of files and derived artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathquarry import schema
from mathquarry.config import Config, Setting
from mathquarry.functions.text import printable

# ---------------------------------------------------------------- files and lines


def files(spark: SparkSession, root: str, with_path: bool = True) -> DataFrame:
    """(file) of the files directly in a folder."""
    f = spark.read.format("binaryFile").load(root).select("path")
    return f.select(F.col("path").alias("file") if with_path else F.element_at(F.split("path", "/"), -1).alias("file")).distinct()


def file_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(name, path): the names listed in a file, blank lines left out, and their places below ``root``."""
    names = lines(spark, path).filter("line <> ''").select(F.col("line").alias("name"))
    return names.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col("name")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx long, line): the lines of one file in their order, from 0."""
    rows = spark.read.text(path).rdd.map(lambda r: r[0].strip()).zipWithIndex()
    return spark.createDataFrame(rows.map(lambda x: (x[1], x[0])), "idx long, line string")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- relational tables


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A table of the relational schema from Parquet below ``path``, or over JDBC with the given options."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{path}/{name}.parquet")


def append_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Appends rows to Parquet tables, columns in the order of the schema."""
    for name, df in tables.items():
        df.select(*schema.TABLES[name].names).write.mode("append").parquet(f"{path}/{name}.parquet")


# ---------------------------------------------------------------- ARFF-JSON


def read_arff_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, classes, data, storage): a corpus of one JSON array per line behind a header line.

    Data is a list of numbers (dense; its zeros are left out) or an object of numbers by index
    (sparse); which of the two is seen row by row.  Lines that are neither are left out.
    """
    raw = spark.read.text(path).filter(~F.ltrim("value").startswith("{") & (F.trim("value") != ""))
    v = F.try_parse_json("value")
    parsed = raw.select(
        F.try_variant_get(v, "$[0][0]", "string").alias("id"), F.try_variant_get(v, "$[0][1]", "array<string>").alias("classes"),
        F.try_variant_get(v, "$[1]", "array<double>").alias("dense"), F.try_variant_get(v, "$[1]", "map<string,double>").alias("sparse"),
    )
    from_dense = F.map_from_entries(F.filter(F.transform("dense", lambda x, i: F.struct(i.alias("k"), x.alias("v"))), lambda e: e["v"] != 0))
    from_sparse = F.map_from_entries(F.transform(F.map_entries("sparse"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v"))))
    storage = F.when(F.col("dense").isNotNull(), "dense").when(F.col("sparse").isNotNull(), "sparse")
    return parsed.filter("id is not null").select("id", "classes", F.when(storage == "dense", from_dense).otherwise(from_sparse).alias("data"), storage.alias("storage"))


def arff_header(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).filter(F.ltrim("value").startswith("{")).first()
    return json.loads(row[0]) if row else {}


def arff_line(ident="id", classes="classes", data="data"):
    """A document as a sparse ARFF-JSON row, indexes ascending."""
    entries = F.array_sort(F.transform(F.map_entries(data), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v"))))
    number = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    cells = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["k"].cast("string"), F.lit('":'), number(e["v"]))), ",")
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(ident), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    names = F.to_json(F.coalesce(classes, F.array().cast("array<string>")))
    return F.concat(F.lit("[["), quoted, F.lit(","), names, F.lit("],{"), cells, F.lit("}]"))


def write_arff_json(df: DataFrame, path: str, relation: str, n_attributes: int, source: str | None = None) -> None:
    """Writes a corpus: its header line, then one line per document; with ``source`` only documents that include it."""
    if source is not None:
        df = df.filter(F.array_contains("included_sources", source))
    header = df.sparkSession.createDataFrame([(0, json.dumps({"relation-name": relation, "num-attributes": n_attributes}))], "o int, value string")
    body = df.select(F.lit(1).alias("o"), arff_line().alias("value"))
    # The header is its own first file, the documents follow in as many as there are partitions.
    header.select("value").coalesce(1).write.mode("overwrite").text(path)
    body.select("value").write.mode("append").text(path)


def corpus_matrix(corpus: DataFrame, selection: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, col, value) of a corpus, or of the documents that ``selection`` keeps."""
    return (selection(corpus) if selection else corpus).select("id", F.explode("data").alias("col", "value"))


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A reproducible part of the rows, chosen by a hash of their key."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


# ---------------------------------------------------------------- matrices, clusters, chi-square


def save_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.COO).parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, cluster) of ``doc;cluster`` lines."""
    return spark.read.csv(path, sep=";", schema=schema.CLUSTERS)


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.select("doc_id", "cluster").write.mode("overwrite").csv(path, sep=";")


def write_chi(scores: DataFrame, path: str, n: int = 1000) -> None:
    """The best ``n`` columns of each class, one folder for each class."""
    w = W.partitionBy("class").orderBy(F.desc("score"), "idx")
    best = scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    best.select("class", "idx", "score", "p").write.mode("overwrite").partitionBy("class").csv(path, sep=";")


def read_chi(spark: SparkSession, path: str) -> DataFrame:
    parts = T.StructType([f for f in schema.CHI.fields if f.name != "class"] + [T.StructField("class", T.StringType())])
    return spark.read.csv(path, sep=";", schema=parts).select("class", "idx", "score", "p")


def main_assignment(msc: DataFrame) -> DataFrame:
    """(document, msc): the code at the first position."""
    return msc.filter("pos = 1").select("document", "msc").distinct()


def read_simple_corpus(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """(id, title, abstract) of ``[id, title, abstract]`` lines; what isn't printable and the first ``skip`` lines are left out."""
    rows = numbered_lines(spark, path).filter(F.col("idx") >= skip).select(F.from_json(printable(F.col("line")), "array<string>").alias("r"))
    return rows.filter(F.size("r") >= 3).select(F.col("r")[0].alias("id"), F.col("r")[1].alias("title"), F.col("r")[2].alias("abstract"))


# ---------------------------------------------------------------- artifacts, models


def artifact(spark: SparkSession, root: str, setting: Setting, name: str, make: Callable[[], DataFrame], config: Config = Config()) -> DataFrame:
    """A derived table stored under its setting: read if it was completed before, made and stored otherwise or when forced."""
    path = f"{root.rstrip('/')}/{setting.key}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    if config.force_gen or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    return kind.load(path)


def to_array(corpus: DataFrame, width: int, most: int = 100_000):
    """Ids and a dense array of a corpus small enough for the driver."""
    import numpy as np

    rows = corpus.select("id", "data").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; keep the matrix distributed")
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        for k, v in r["data"].items():
            out[i, k] = v
    return [r["id"] for r in rows], out


def per_document(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], result: str) -> DataFrame:
    """An extension point: any Python function over batches of rows."""
    return df.mapInPandas(f, result)


def scheme_of(path: str) -> str:
    return urlparse(path).scheme or "file"
