"""Continuous ingest of article files; an addition of this engine's own.

Files that arrive in a folder are parsed as they come and appended to the
relational tables.  Each micro-batch is written once: a batch that was completed
before is skipped when a query restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry import schema
from mathquarry.sources.articles import parse_articles, to_tables


def article_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, xml) of the files that arrive in ``folder``."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """Starts the query; malformed articles go to the table ``rejected`` (path, error)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        articles = parse_articles(batch).persist()
        try:
            for name, df in to_tables(articles).items():
                # one folder per batch makes a repeated batch overwrite itself
                df.select(*schema.TABLES[name].names).write.mode("overwrite").parquet(f"{target}/{name}.parquet/batch={batch_id}")
            articles.filter("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{target}/rejected.parquet/batch={batch_id}")
        finally:
            articles.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_count_stream(paragraphs: DataFrame, delay: str = "1 day", window: str = "30 days") -> DataFrame:
    """(window, token, n) of a stream of paragraphs (text, loaded_at): counts per window of loading, late rows within ``delay``."""
    from mathquarry.functions.text import word_tokens

    rows = paragraphs.select(F.col("loaded_at").cast("timestamp").alias("loaded_at"), F.explode(word_tokens(F.col("text"))).alias("token"))
    return rows.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window), "token").agg(F.count("*").alias("n"))
