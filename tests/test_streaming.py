from mathquarry.streaming import ingest
from tests.test_sources import ARTICLE


def test_article_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.xml").write_text(ARTICLE)
    (src / "bad.xml").write_text("<doc>")
    for n in (1, 2):
        ingest.ingest(ingest.article_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/document.parquet")).count() == n
        assert spark.read.parquet(str(tmp_path / "out/rejected.parquet")).count() == 1
        (src / "2.xml").write_text(ARTICLE)


def test_token_count_stream(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/theorem.parquet")
    source.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "t"))
    q = ingest.token_count_stream(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.sql("select sum(n) from counted").first()[0]
    from pyspark.sql import functions as F

    from mathquarry.functions.text import word_tokens

    assert total == source.select(F.explode(word_tokens(F.col("text")))).count()
