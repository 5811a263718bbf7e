"""Properties that hold for any input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mathquarry.functions import formula, review, text
from mathquarry.operators import coo, counts, evaluation
from mathquarry.session import table


@given(st.text(alphabet="ab$[](){}\\it ,.:XY1", max_size=60))
@settings(max_examples=300, deadline=None)
def test_review_scan_keeps_the_text(s):
    """Every character is in a token, but for the marks around formulas, references, authors and brackets."""
    kinds = {k for k, _ in review.scan(s)}
    assert kinds <= {"formula", "reference", "author", "braced", "separator", "blank", "string"}
    if not set(s) & set("$[({"):
        assert "".join(t for _, t in review.scan(s)) == s


@given(st.recursive(st.sampled_from(["<ci>x</ci>", "<cn>1</cn>", "<plus/>"]), lambda inner: st.lists(inner, min_size=1, max_size=4).map(lambda c: f"<apply>{''.join(c)}</apply>"), max_leaves=12))
@settings(max_examples=200, deadline=None)
def test_formula_features(xml):
    xml = f"<math>{xml}</math>"
    o, u = ([t for t in formula.kristianto(xml) if t.startswith(p)] for p in ("o:", "u:"))
    assert len(o) == len(u)
    assert sum(t.startswith("sym:") for t in formula.content_features(xml)) == xml.count("<ci>")
    assert formula.lin(xml) or xml == "<math><plus/></math>"


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_stems_and_escapes(s):
    assert len(text.porter(s.lower())) <= len(s.lower()) + 1
    assert text.ascii_escape_text(s).isascii()


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_do_not_depend_on_partitions(spark, data, parts):
    pars = table(spark, data, "theorem").select("document", "paragraph_id", "text").distinct()
    one = counts.token_counts(counts.word_rows(pars.coalesce(1)))
    other = counts.token_counts(counts.word_rows(pars.repartition(parts)))
    assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


def test_numbers_are_dense(spark, data):
    words = counts.word_rows(table(spark, data, "theorem").select("document", "paragraph_id", "text").distinct())
    v = coo.vocabulary(words).agg(F.count("*").alias("n"), F.count_distinct("idx").alias("k"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    assert v["n"] == v["k"] == v["hi"] + 1 and v["lo"] == 0


def test_jaccard_is_symmetric_and_bounded(spark, data):
    docs = table(spark, data, "documents")
    a = docs.filter("source is not null").select("doc_id", F.col("source").alias("cluster"))
    b = docs.filter("msc is not null").select("doc_id", F.col("msc").alias("category"))
    one = evaluation.overlap(a, b).select("cluster", "category", "jaccard")
    other = evaluation.overlap(b.withColumnRenamed("category", "cluster"), a.withColumnRenamed("cluster", "category")).select(F.col("category").alias("cluster"), F.col("cluster").alias("category"), "jaccard")
    assert one.exceptAll(other).count() == 0 and one.filter("jaccard < 0 or jaccard > 1").count() == 0
