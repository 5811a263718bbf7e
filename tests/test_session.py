import types

import pytest
from pyspark.sql import functions as F

from mathquarry import session
from mathquarry.operators import counts, evaluation


def test_scratch_tables_go(spark):
    df = session.materialize(spark.range(5), "five")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert df.count() == 5 and files.exists(path)
    session.discard(df)
    assert not files.exists(path)
    other = session.materialize(spark.range(3), "three")
    session.cleanup(spark)
    assert not files.exists(spark._jvm.org.apache.hadoop.fs.Path(other._scratch))
    assert session.materialize(spark.range(3), "again").count() == 3


def test_a_cluster_needs_a_shared_folder():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    context.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    cluster.conf = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert session.shared_dir(cluster) == "hdfs://host/shared"


def test_lists_are_bounded(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 3), (None, 4)], "g string, doc_id int")
    assert sorted((r["g"] or "", r["members"]) for r in evaluation.group_sets(rows, "g", most=2).collect()) == [("", [4]), ("a", [1, 2]), ("b", [3])]
    with pytest.raises(Exception, match="more than 1 rows"):
        evaluation.group_sets(rows, "g", most=1).collect()
    assert evaluation.group_members(rows, "g").count() == 4


def test_sets_of_any_size(spark):
    """A group of more than 100,000 members, in several range parts, some repeated; beside it small ones."""
    n = 100_001
    large = spark.range(n).selectExpr("'a' AS g", "id * 7919 % 100001 AS doc_id")
    rows = large.union(large.limit(5)).union(spark.createDataFrame([("b", 3), ("b", 1), (None, 4)], "g string, doc_id long"))
    got = {r["g"]: r["members"] for r in evaluation.group_sets(rows, "g").collect()}
    assert got == {"a": list(range(n)), "b": [1, 3], None: [4]}


def test_token_lists_in_pieces(spark):
    """Places in a document's list, whatever the range parts are; ties, nulls and a hot document included."""
    rows = [("hot", f"p{i:03d}", "aa bb cc"[: 3 * (i % 3) + 2]) for i in range(200)] + [("hot", "p000", "zz yy"), ("d", None, "xx yy"), ("d", "p1", None), ("d", "p1", "ww"), (None, "p", "vv uu tt")]
    df = spark.createDataFrame(rows, "document string, paragraph_id string, text string").repartition(7)
    got = counts.document_tokens(df).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["document"], []).append((r["at"], r["tokens"]))
    want = {}
    for d, p, t in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", (r[2] or "").split())):
        want.setdefault(d, []).extend((t or "").split())
    for d, pieces in lists.items():
        joined = [t for _, tokens in sorted(pieces) for t in tokens]
        assert joined == want[d]
        at = 0
        for start, tokens in sorted(pieces, key=lambda x: (x[0], len(x[1]))):
            assert start == at
            at += len(tokens)
    assert counts.document_tokens(df.limit(0)).count() == 0
    assert {r["document"]: r["tokens"] for r in counts.document_token_list(df).collect()}["hot"] == want["hot"]
    with pytest.raises(Exception, match="more than 100 rows"):
        counts.document_token_list(df, most=100).collect()


def test_mentions(spark):
    rows = spark.createDataFrame([(t,) for t in ["euler", "euler", "other", None]], "token string")
    names = spark.createDataFrame([("euler",), ("gauss",), ("euler",), (None,)], "token string")
    assert [tuple(r) for r in counts.mentions(rows, names).collect()] == [("euler", 2)]
    assert counts.mentions(rows, names.filter(F.lit(False))).count() == 0


def test_diagonal_mixture(spark):
    """Components of different spread along the axes are told apart; the likelihood is that of the true ones at least."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from mathquarry.models import ml

    rng = np.random.default_rng(4)
    parts = [rng.normal([0, 0, 0], [1.5, 0.2, 1], (400, 3)), rng.normal([0, 4, 0], [1.5, 0.2, 1], (300, 3)), rng.normal([30, 2, 0], [0.3, 3, 1], (200, 3))]
    rows = [(i, x.tolist(), j) for i, (j, x) in enumerate((j, x) for j, p in enumerate(parts) for x in p)]
    v = spark.createDataFrame(rows, "row_id long, x array<double>, part int").withColumn("features", array_to_vector("x"))
    model = ml.diagonal_mixture(v, k=3, iterations=40, runs=4)
    true = ml.DiagonalMixture(np.array([4, 3, 2]) / 9, np.array([[0, 0, 0], [0, 4, 0], [30, 2, 0.0]]), np.array([[1.5, 0.2, 1], [1.5, 0.2, 1], [0.3, 3, 1]]) ** 2, 0.0)
    joint = true.log_joint(np.concatenate(parts))
    assert model.likelihood > np.log(np.exp(joint).sum(axis=1)).mean() - 0.1
    found = ml.diagonal_labels(model, v).join(v, "row_id").groupBy("part", "cluster").count().collect()
    assert sum(max(r["count"] for r in found if r["part"] == j) for j in range(3)) > 0.98 * len(rows)
