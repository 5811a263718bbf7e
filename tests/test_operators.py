import math

import pytest
from pyspark.sql import functions as F

from mathquarry.config import Config, Setting
from mathquarry.models import ml
from mathquarry.operators import authors, coo, counts, evaluation, orphans, phrase, weighting

M = [[1, 0, 2], [1, 1, 0], [3, 0, 0]]


def matrix(spark, rows):
    cells = [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    return spark.createDataFrame(cells, "row_id long, col int, value double")


def dense(df, n, m):
    out = [[0.0] * m for _ in range(n)]
    for r in df.collect():
        out[r["row_id"]][r["col"]] = round(r["value"], 6)
    return out


def row_ids(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"))


def test_build(spark):
    rows = [(0, "foo", 0.3), (0, "hello", -1.1), (1, "bar", 0.5), (1, "baz", 0.5), (2, "bar", 2.2), (2, "hello", 0.6), (2, "test", -0.2)]
    df = spark.createDataFrame(rows, "row_id long, token string, value double")
    vocab = spark.createDataFrame([("foo", 0), ("bar", 1), ("baz", 2)], "token string, idx int")
    assert dense(coo.build(df, vocab), 3, 3) == [[0.3, 0, 0], [0, 0.5, 0.5], [0, 2.2, 0]]
    direct = spark.createDataFrame([(0, 0, 0.3), (0, 2, 1.1), (1, 1, 0.5), (1, 2, 0.5), (2, 2, 2.2)], "row_id long, token int, value double")
    assert dense(coo.build(direct, columns=4), 3, 4) == [[0.3, 0, 1.1, 0], [0, 0.5, 0.5, 0], [0, 0, 2.2, 0]]
    for bad in ({}, {"vocab": vocab, "columns": 4}):
        with pytest.raises(ValueError):
            coo.build(df, **bad)


def test_weights(spark):
    m, rows = matrix(spark, M), row_ids(spark, 3)
    w = weighting.tf_idf(m, rows.agg(F.count("*").alias("n")))
    assert dense(w, 3, 3) == [[0.283217, 0, 0.959056], [0.508542, 0.861037, 0], [1, 0, 0]]
    assert {r["col"]: round(r["score"], 6) for r in weighting.column_sums(w).collect()} == {0: 1.791759, 1: 0.861037, 2: 0.959056}
    assert round(coo.average_row_norm(m, rows).first()[0], 6) == 2.216761
    assert abs(coo.average_row_norm(m, row_ids(spark, 4)).first()[0] - 2.216761 * 3 / 4) < 1e-6
    assert all(abs(r["norm"] - 1) < 1e-9 for r in coo.row_norms(w).collect())
    assert dense(weighting.balance(m, coo.scale(m, 2.0), rows), 3, 3) == M
    assert weighting.balance(m, m.limit(0), rows).count() == 0


def test_matrix_algebra(spark):
    m = matrix(spark, M)
    assert dense(coo.multiply(m, coo.transpose(m)), 3, 3) == [[5, 1, 3], [1, 2, 3], [3, 3, 9]]
    assert dense(coo.stack_rows(m, m, 3, 3, 3), 6, 3) == M + M
    assert dense(coo.append_columns(m, m, 3, 3, 3), 3, 6) == [r + r for r in M]
    for f in (coo.stack_rows, coo.append_columns):
        with pytest.raises(ValueError):
            f(m, m, 3, 3, 4)
    features = spark.createDataFrame([(2,), (0,)], "col int")
    assert dense(coo.project_reindex(m, features), 3, 2) == [[1, 2], [1, 0], [3, 0]]
    assert dense(coo.from_vectors(coo.to_vectors(m, 3)), 3, 3) == M
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "row_id long, group long")
    assert dense(coo.sum_rows_by(m, groups), 2, 3) == [[2, 1, 2], [3, 0, 0]]
    signed = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 0, 2.0)], "row_id long, col int, value double")
    assert [r[0] for r in coo.nonzero_rows(signed).collect()] == [1]
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, idx int")
    assert {r[0]: r[1] for r in coo.token_weights(m, vocab).collect()}[0] == {"a": 1.0, "c": 2.0}
    pos = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pos int, item string")
    assert sorted(r[0] for r in coo.indexes_in(pos, spark.createDataFrame([("x",)], "item string")).collect()) == [0, 2]


def test_vocabulary_is_in_byte_order(spark):
    words = ["b", "a", "é", "z", "Z", "aa", "zz", "a", "aaaa1", "aaaa0"]
    df = spark.createDataFrame([(w,) for w in words], "token string").repartition(5)
    got = {r["token"]: r["idx"] for r in coo.vocabulary(df).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}
    assert [r["token"] for r in coo.vocabulary(df, least=2).collect()] == ["a"]
    assert coo.vocabulary(df.limit(0)).count() == 0


def test_processed_matrix(spark):
    rows = [("d1", "t:a", 2), ("d1", "o:x", 4), ("d2", "t:a", 1), ("d2", "t:b", 1), ("d3", "o:x", 1)]
    c = spark.createDataFrame(rows, "document string, token string, n long")
    items = spark.createDataFrame([("d1",), ("d2",), ("d3",), ("d4",)], "document string")
    raw = weighting.raw_matrix(c, items, ["document"], 1)
    p = weighting.processed_matrix(raw)
    assert {r["token"]: r["idx"] for r in p.vocab.collect()} == {"t:a": 0, "t:b": 1, "o:x": 2}
    assert sorted(r["document"] for r in p.rows.collect()) == ["d1", "d2", "d3"]
    assert {r["token"] for r in weighting.processed_matrix(raw, 1, 0).vocab.collect()} == {"t:a"}
    plain = weighting.processed_matrix(weighting.raw_matrix(c.filter("token like 't:%'"), items, ["document"], 1))
    assert {r["token"] for r in plain.vocab.collect()} == {"t:a", "t:b"}


def test_chi2(spark):
    labels = spark.createDataFrame([(0, "0"), (1, "1"), (2, "1")], "row_id long, class string")
    got = {(r["class"], r["col"]): (round(r["score"], 6), r["p"]) for r in evaluation.chi2_scores(matrix(spark, M), labels, with_p=True).collect()}
    assert [got["1", c][0] for c in range(3)] == [0.4, 0.5, 4.0] and [got["0", c][0] for c in range(3)] == [0.4, 0.5, 4.0]
    assert abs(got["1", 2][1] - math.erfc(math.sqrt(2))) < 1e-12
    scores = evaluation.chi2_scores(matrix(spark, M), labels)
    assert [r["col"] for r in evaluation.chi2_top(scores, 1).filter("class = '1'").collect()] == [2]
    assert sorted(r[0] for r in evaluation.chi2_columns(scores, 0.45).collect()) == [1, 2]
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, idx int")
    assert {r["token"] for r in evaluation.chi2_terms(scores, vocab, 0.55).collect()} == {"c"}


def test_spearman(spark):
    a = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "t string, value double")
    b = spark.createDataFrame([("b", 5.0), ("c", 4.0), ("d", 1.0)], "t string, value double")
    r = evaluation.spearman(evaluation.align(a, b, ["t"]).withColumn("g", F.lit(1)), ["g"]).withColumn("p", evaluation.spearman_p("rho", "n")).first()
    assert round(r["rho"], 6) == -0.2 and r["n"] == 4 and abs(r["p"] - 0.8) < 1e-6
    flat = evaluation.spearman(spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0)], "t string, x double, y double").withColumn("g", F.lit(1)), ["g"]).first()
    assert flat["rho"] is None


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 1, 3, 7, 100)], "v int")
    got = sorted((r["bin"], r["label"], r["n"]) for r in evaluation.histogram(df, "v", [0, 1, 2, 3, 4, 5, 100]).collect())
    assert [g[2] for g in got] == [1, 2, 0, 1, 0, 1] and [g[1] for g in got] == ["0", "1", "2", "3", "4", "5 - 99"]
    kept = sorted((r["bin"], r["n"]) for r in evaluation.histogram(df, "v", [0, 1, 2, 3, 4, 5, 100], keep_empty=False).collect())
    assert [n for _, n in kept] == [1, 2, 1, 1]


def test_overlap_and_quality(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (1, "x")], "doc_id int, cluster string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (2, "p"), (9, "r")], "doc_id int, category string")
    got = {(r["cluster"], r["category"]): (r["n_common"], round(r["jaccard"], 3)) for r in evaluation.overlap(a, b).collect()}
    assert len(got) == 6 and got["x", "p"] == (2, 1.0) and got["y", "r"] == (0, 0.0) and got["x", "q"] == (1, 0.5)
    p = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 1)], "label int, prediction int")
    r = evaluation.confusion(p).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) == (1, 0, 1, 1, 1.0, 0.5) and abs(r["f1"] - 2 / 3) < 1e-9
    none = evaluation.confusion(p.limit(0)).first()
    assert none["precision"] is None and none["f1"] is None
    c = spark.createDataFrame([("d", ["05C10", "11"]), ("e", [])], "doc_id string, classes array<string>")
    assert {tuple(r) for r in evaluation.class_members(c).collect()} == {("d", "05"), ("d", "11")}
    assert [tuple(r) for r in evaluation.class_members(c, False).collect()] == [("d", "05")]


def test_authors(spark):
    a = spark.createDataFrame([("d1", 1, "A", "a.1"), ("d2", 1, "A", "a.1"), ("d2", 2, "B", None), ("d3", 1, "C", "c"), ("d3", 3, "D", None), ("d3", 2, "", None)], "document string, rank int, display_name string, zbmath_id string")
    m = spark.createDataFrame([("d1", "05C10", 1), ("d2", "05A", 1), ("d2", "11B", 2), ("d3", "11", 4), ("d3", "xx", 1)], "document string, msc string, pos int")
    c = authors.author_msc_counts(a, m)
    assert {(r[0], r[1], r[2]) for r in c.collect()} == {("A", "05", 2), ("A", "11", 1), ("B", "05", 1), ("B", "11", 1)}
    near = [(r[0], r[1]) for r in authors.similar_authors(c, "A").collect()]
    assert near[0] == ("A", 0.0) and near[1] == ("B", round(1 - 3 / math.sqrt(10), 6))
    assert [r[1] for r in authors.similar_authors(c, "A", metric="euclidean").collect()] == [0.0, 1.0]
    assert [r[1] for r in authors.similar_authors(c, "A", metric="cityblock").collect()] == [0.0, 1.0]
    with pytest.raises(authors.NoSuchAuthor):
        authors.find_author(c, "Z")
    docs = spark.createDataFrame([("d1",), ("d2",), ("d4",)], "document string")
    lines = sorted(r["line"] for r in authors.ids_with_authors(docs, a, ["document"]).collect())
    assert lines == ["d1;A(a.1);", "d2;A(a.1);B(None)", "d4;;;"]
    rows = spark.createDataFrame([(0, "d1"), (1, "d2"), (2, "d3")], "row_id long, document string")
    pairs = authors.author_items(rows, a)
    assert {(r[0], r[1]) for r in pairs.collect()} == {("A", 0), ("A", 1), ("B", 1), ("C", 2)}
    items, by_item = authors.author_item_maps(pairs)
    assert {r[0]: r[1] for r in items.collect()}["A"] == [0, 1] and {r[0]: r[1] for r in by_item.collect()}[1] == ["A", "B"]
    topics = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5), (2, 1, 1.0)], "row_id long, topic int, weight double")
    mass = {r[0]: r[1] for r in authors.author_walk(pairs, topics, "A").collect()}
    assert abs(sum(mass.values()) - 1) < 1e-9 and mass["A"] > mass["B"] and mass["C"] > 0
    scores = [r[0] for r in authors.best_authors(authors.topic_scores(pairs, topics, "A"), "score", 2).collect()]
    assert scores[0] == "A"


def test_phrase(spark):
    s = spark.createDataFrame([(1, ["a", "a", "a", "b"]), (2, ["a", "a", "b"]), (3, ["b", "a"]), (4, [])], "id int, tokens array<string>")
    assert [r[0] for r in phrase.matches(s, ["a", "a", "b"]).collect()] == [1, 2]
    assert [r[0] for r in phrase.matches(s, ["a", "a", "b"], "reference").collect()] == [2]
    assert phrase.matches(s, []).count() == 0
    rows = s.select("id", F.explode("tokens").alias("token"))
    assert sorted(r[0] for r in phrase.candidates(rows, ["a", "b"], ["id"]).collect()) == [1, 2, 3]
    assert phrase.candidates(rows, [], ["id"]).count() == 0


def test_counts(spark):
    p = spark.createDataFrame([("d", "p1", "big <fid F1> big"), ("d", "p2", "set <fid F9>"), ("d", "p1", "big <fid F1> big"), ("e", "p1", None)], "document string, paragraph_id string, text string")
    f = spark.createDataFrame([("d", "F1", "<math><apply><plus/><ci>x</ci></apply></math>"), ("d", "F2", "bad")], "document string, formula_id string, c_math_ml string")
    src = counts.paragraph_source(p, p, "full_text")
    assert src.count() == 3
    rows = counts.mixed_rows(src, f, "lin").collect()
    assert [r["token"] for r in sorted(rows, key=lambda r: (r["document"], r["paragraph_id"], r["part_pos"], r["token_pos"])) if r["paragraph_id"] == "p1"] == ["t:big", "math(apply(plus#ci(x)))", "apply(plus#ci(x))", "ci(x)", "apply(plus>ci())", "math(apply(plus))", "t:big"]
    with pytest.raises(ValueError):
        counts.mixed_rows(src, f, "other")
    words = counts.word_rows(src)
    assert {(r[0], r[1]): r[2] for r in counts.item_counts(words).collect()}["d", "big"] == 2
    assert {(r[0], r[1]): r[2] for r in counts.item_counts(words, mode="reference").collect()}["d", "big"] == 1
    assert {r[0]: r[1] for r in counts.document_token_list(src).collect()}["d"] == ["big", "fid", "f1", "big", "set", "fid", "f9"]
    a = spark.createDataFrame([("d", "t:a", 1)], "document string, token string, n long")
    b = spark.createDataFrame([("d", "o:b", 2)], "document string, token string, n long")
    assert counts.merge_features(a, b).count() == 2
    with pytest.raises(Exception):
        counts.merge_features(a, a).collect()
    with pytest.raises(Exception):
        counts.merge_features(a, b.withColumn("document", F.lit("e"))).collect()
    art = spark.createDataFrame([(["zbmath metadata"], ["a", "a"]), (["x"], ["b"]), (None, ["c"])], "included_sources array<string>, tokens array<string>")
    assert [tuple(r) for r in counts.sourced_word_counts(art).collect()] == [("a", 2)]


def test_orphans(spark):
    t = lambda s: f"2024-{s} 00:00:00"
    cast = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    refs = cast(spark.createDataFrame([("s", k, t("02-10"), i) for i, k in enumerate(["here", "gone", "back", "none", "later", "same", None, "none"])] + [("s", "later", t("05-01"), 9), ("o", "here", t("02-10"), 10)], "scope string, key string, first string, rec int"), "first")
    loads = cast(spark.createDataFrame([("s", "here", t("01-01")), ("s", "gone", t("01-01")), ("s", "back", t("01-01")), ("s", "back", t("03-03")), ("s", "later", t("04-01")), ("s", "same", t("02-20")), ("s", None, t("01-01"))], "scope string, key string, at string"), "at")
    gone = cast(spark.createDataFrame([("s", "gone", t("01-05")), ("s", "gone", t("01-02")), ("s", "back", t("02-01")), ("s", "never", t("02-01"))], "scope string, key string, at string"), "at")
    refs = refs.withColumns({c: F.lit("clash") for c in ("state", "period", "first_load", "id", "at", "what")})
    found = orphans.orphan_references(refs, loads, gone)
    assert {r["period"] for r in found.collect()} == {"clash"}
    got = sorted((r["rec"], r["state"]) for r in found.collect())
    assert got == [(1, "deleted"), (3, "missing"), (4, "late"), (5, "late"), (7, "missing"), (10, "missing")]
    assert orphans.orphan_references(refs.limit(0), loads, gone).count() == 0
    assert {r["state"] for r in orphans.orphan_references(refs, loads.limit(0), gone.limit(0)).collect()} == {"missing"}


def test_bitmaps():
    import numpy as np

    for n in (0, 1, 1000, 1024, 20_000, 32_768):
        bits = np.sort(np.random.default_rng(n).choice(orphans.RANGE, n, replace=False))
        assert np.array_equal(np.flatnonzero(orphans.expand(orphans.compress(bits))), bits)


def test_reference_notations(spark):
    notes = ["<fid A.1>", "<FID  A.1 >", "&lt;fid A.1&gt;", '<fid "A.1">', "<fid A.1/>", "<fid A.1>", "<fid\nA.1>", "<Fid &quot;A.1&quot;>"]
    df = spark.createDataFrame([(x,) for x in notes], "t string")
    assert [r[0] for r in df.select(orphans.formula_references(F.col("t"))).collect()] == [["A.1"]] * len(notes)
    none = spark.createDataFrame([("<fid >",), ("<fig 2>",), ("fid A",), (None,)], "t string").select(orphans.formula_references(F.col("t"))).collect()
    assert [r[0] for r in none] == [[], [], [], None]
    keys = spark.createDataFrame([(x,) for x in ("arXiv: 1608.001026v2", " AN-OP/0409001\n", "1608.001026")], "k string").select(orphans.article_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == ["1608.001026", "an-op/0409001", "1608.001026"]


def blobs(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([10.0 * (i % 3) + 0.01 * i, float(i % 3)]), i % 3) for i in range(30)]
    return spark.createDataFrame(rows, ["row_id", "features", "label"])


def same_grouping(rows, key):
    groups = {}
    for r in rows:
        groups.setdefault(r[key], set()).add(r["row_id"] % 3)
    return len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_models(spark):
    v = blobs(spark)
    assert same_grouping(ml.labels(ml.kmeans(v, 3, runs=2), v).collect(), "cluster")
    assert same_grouping(ml.affinity_propagation(v, damping=0.5, iterations=40, patience=10).collect(), "exemplar")
    assert same_grouping(ml.mean_shift(v, 3.0).collect(), "cluster")
    with pytest.raises(ValueError):
        ml.mean_shift(v, most=10)
    train, test = ml.hash_split(v.withColumn("label", (F.col("label") == 2).cast("int")), "row_id", 0.6)
    assert train.count() + test.count() == 30
    q = evaluation.confusion(ml.predicted(ml.linear_svc(train), test)).first()
    assert q["fp"] == q["fn"] == 0
    reduced, s = ml.svd(coo.to_vectors(matrix(spark, M), 3), 2)
    assert s[0] >= s[1] and len(reduced.first()["features"]) == 2


def test_settings(spark, tmp_path):
    assert Setting("only_theorems", "lin", "paragraphs").key == "only_theorems__lin__paragraphs"
    with pytest.raises(ValueError):
        Setting(token_method="x")
    p = tmp_path / "c.json"
    p.write_text('{"min_token_count": 5, "other": 1}')
    assert Config.load(spark, str(p)) == Config(min_token_count=5)


def test_topics_take_every_row(spark):
    """Counts stay sparse, and each iteration takes each row once: the model doesn't depend on how rows are spread."""
    from pyspark.ml.linalg import DenseVector, SparseVector, Vectors

    mixed = spark.createDataFrame([(1, Vectors.sparse(4, [0, 2], [1.5, 0.2])), (2, Vectors.dense([0.5, 2.4, 0.0, 3.0]))], ["row_id", "features"])
    assert {r["row_id"]: r["features"] for r in ml.whole_numbers(mixed).collect()} == {1: SparseVector(4, [0, 2], [2.0, 0.0]), 2: DenseVector([1.0, 2.0, 0.0, 3.0])}
    rows = spark.createDataFrame([(i, Vectors.sparse(40, {20 * (i % 2) + (i * 7 + j * j) % 20: 1.0 + j % 3 for j in range(8)})) for i in range(200)], ["row_id", "features"])
    models = [ml.lda(rows.repartition(n), topics=2, iterations=5) for n in (1, 5)]
    first, second = (m.topicsMatrix().toArray() for m in models)
    assert abs(first - second).max() < 1e-3 * first.max()
