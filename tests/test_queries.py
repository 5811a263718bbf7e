import pytest

from mathquarry.plans import registry
from tests.oracle import compare, duck

WITH_SQL = sorted(registry.oracle_sql())
MODELS = {"gmm_labels", "affinity_exemplars", "svd_lsa", "kmeans_labels", "linear_svc", "lda_topics", "word_neighbours", "mean_shift_clusters", "text_clusters", "diagonal_mixture_labels", "svd_classifier"}
WITHOUT_SQL = sorted(set(registry.queries()) - set(WITH_SQL) - MODELS)


@pytest.mark.parametrize("name", WITH_SQL)
def test_agrees_with_sql(spark, data, name):
    assert compare(spark, data, name, duck(data)) is None


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs_with_stable_schema(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def run(spark, data, name):
    return registry.queries()[name](spark, data).collect()


def test_label_models(spark, data):
    """Every item has one label of those there are, and more than one is used."""
    items = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    for name in ("kmeans_labels", "gmm_labels", "diagonal_mixture_labels"):
        rows = run(spark, data, name)
        assert sorted(r["row_id"] for r in rows) == sorted(items) and {r["cluster"] for r in rows} <= set(range(10)) and len({r["cluster"] for r in rows}) > 1
    titles = run(spark, data, "text_clusters")
    assert titles and {r["cluster"] for r in titles} <= set(range(5))


def test_exemplars_and_modes(spark, data):
    rows = {r["row_id"]: r["exemplar"] for r in run(spark, data, "affinity_exemplars")}
    assert rows and all(rows[e] == e for e in rows.values())
    modes = run(spark, data, "mean_shift_clusters")
    assert len({r["row_id"] for r in modes}) == len(modes) and {r["cluster"] for r in modes} == set(range(len({r["cluster"] for r in modes})))


def test_reduction_keeps_the_largest_part(spark, data):
    rows = run(spark, data, "svd_lsa")
    power = [sum(r["features"][i] ** 2 for r in rows) for i in range(10)]
    assert rows and all(len(r["features"]) == 10 for r in rows) and all(a >= b * 0.999 for a, b in zip(power, power[1:]))


def test_topics_and_neighbours(spark, data):
    topics = {}
    for r in run(spark, data, "lda_topics"):
        topics.setdefault(r["topic"], []).append((r["place"], r["weight"]))
    assert len(topics) == 10 and all([w for _, w in sorted(t)] == sorted(w for _, w in t) for t in topics.values())
    near = run(spark, data, "word_neighbours")
    assert len(near) == 20 and [r["similarity"] for r in near] == sorted((r["similarity"] for r in near), reverse=True)


def test_classifier_is_better_than_chance(spark, data):
    for name in ("linear_svc", "svd_classifier"):
        (r,) = run(spark, data, name)
        n = r["tp"] + r["fp"] + r["fn"] + r["tn"]
        assert n > 0 and (r["tp"] + r["tn"]) / n >= max(r["tp"] + r["fn"], r["fp"] + r["tn"]) / n - 0.1


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows[0]["distance"] == 0 and len(rows) == 20


def test_llm_is_optional():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "mathquarry"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "mathquarry.llm" not in p.read_text(), p
