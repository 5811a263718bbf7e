import json

from pyspark.sql import functions as F

from mathquarry.config import Config, Setting
from mathquarry.sources import articles, io

ARTICLE = """<doc>
  <included_sources><source>zbmath metadata</source></included_sources>
  <metadata>
    <identifiers><id type="arxiv">0704.0005</id><id type="doi">10.1/x</id></identifiers>
    <arxiv_title>T &amp; U</arxiv_title><arxiv_abstract>A</arxiv_abstract>
    <arxiv_publication_date>2007-04-02T00:00:00</arxiv_publication_date>
    <languages><language>en</language></languages>
    <authors><author><name>Ann B</name></author></authors>
    <zb_author_identifiers><author_identifier>b.ann</author_identifier></zb_author_identifiers>
    <semantic_metadata><arxiv><cat>math.CO</cat></arxiv><zb_msc><cat>05C10</cat><cat>11</cat></zb_msc></semantic_metadata>
  </metadata>
  <content>before
    <div id="p1">Let <math id="F1" alttext="x+1"><semantics><mrow><mi>x</mi></mrow>
      <annotation-xml><apply><plus/><ci>x</ci><cn>1</cn></apply></annotation-xml></semantics></math> be <math alttext="y"/>.</div>
    <div id="p2"></div>
    <div id="Thmlem1.p1">So<div id="inner"> it is</div></div>
    <div id="p9"></div>
  </content>
</doc>"""


def parsed(spark, xml=ARTICLE, **kw):
    return articles.parse_articles(spark.createDataFrame([("a", xml)], "path string, xml string"), **kw)


def test_metadata(spark):
    for only in (True, False):
        r = parsed(spark, metadata_only=only).first()
        assert (r["title"], r["abstract"], str(r["publication_date"]), r["languages"]) == ("T & U", "A", "2007-04-02", ["en"])
        assert [tuple(x) for x in r["identifiers"]] == [("0704.0005", "arxiv"), ("10.1/x", "doi")]
        assert [tuple(x) for x in r["authors"]] == [("Ann B", "b.ann")] and r["zb_msc_cats"] == ["05C10", "11"]
        assert (r["content"] == []) is only
    two = ARTICLE.replace("<author><name>Ann B</name></author>", "<author><name>Ann B</name></author><author><name>C</name></author>")
    assert [tuple(x) for x in parsed(spark, two).first()["authors"]] == [("Ann B", None), ("C", None)]


def test_paragraphs_and_formulas(spark):
    a = parsed(spark)
    p = {r["paragraph_id"]: " ".join(r["text"].split()) for r in articles.paragraphs(a).collect()}
    assert p == {"p1": "before Let <fid F1> be .", "p2": "", "Thmlem1.p1": "So it is"}
    f = articles.formulas(a).collect()
    assert len(f) == 1 and f[0]["latex"] == "x+1" and f[0]["c_math_ml"] == "<math><apply><plus></plus><ci>x</ci><cn>1</cn></apply></math>" and f[0]["p_math_ml"] == "<math><mrow><mi>x</mi></mrow></math>"
    tokens = articles.full_text_tokens(a).first()["tokens"]
    assert tokens == ["before", "let", "$x$", "$+$", "$1$", "be", "so", "it", "is"]
    s = {r["paragraph_id"]: r["sentences"] for r in articles.structured_paragraphs(a).collect()}
    assert s["p1"] == [["before", "let", "<fid F1>", "be"]]


def test_tables_round_trip(spark, tmp_path):
    t = articles.to_tables(parsed(spark))
    assert [tuple(r)[:3] for r in t["document"].collect()] == [("0704.0005", "T & U", "05")]
    assert [(r["paragraph_id"], r["theorem_type"]) for r in t["theorem"].collect()] == [("Thmlem1.p1", "lemma")]
    assert [tuple(r) for r in t["msc_assignment"].orderBy("pos").collect()] == [("0704.0005", "05C10", 1), ("0704.0005", "11", 2)]
    io.append_tables(t, str(tmp_path))
    io.append_tables({"document": t["document"]}, str(tmp_path))
    assert io.read_table(spark, "document", str(tmp_path)).count() == 2 and io.read_table(spark, "authorship", str(tmp_path)).first()["zbmath_id"] == "b.ann"


def test_malformed_and_files(spark, tmp_path):
    assert parsed(spark, "<doc>").first()["error"] and parsed(spark, None).first()["error"]
    for n in ("1.xml", "2.xml"):
        (tmp_path / n).write_text(ARTICLE)
    assert articles.read_articles(spark, str(tmp_path)).filter("error is null").count() == 2
    assert sorted(r[0] for r in io.files(spark, str(tmp_path), False).collect()) == ["1.xml", "2.xml"]
    (tmp_path / "list").mkdir()
    (tmp_path / "list/names.txt").write_text("1.xml\n\n 2.xml \n")
    assert sorted(r["path"] for r in io.file_list(spark, str(tmp_path / "list"), "/root/").collect()) == ["/root/1.xml", "/root/2.xml"]


def test_arff(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"relation-name":"c","num-attributes":4}\n[["d1",["05C10","11"]],{"3":2,"0":1}]\n[["d2",[]],[0.5,0,1]]\nnonsense\n')
    c = io.read_arff_json(spark, str(tmp_path / "in.json"))
    rows = {r["id"]: r for r in c.collect()}
    assert rows["d1"]["data"] == {3: 2.0, 0: 1.0} and rows["d1"]["storage"] == "sparse" and rows["d1"]["classes"] == ["05C10", "11"]
    assert rows["d2"]["data"] == {0: 0.5, 2: 1.0} and rows["d2"]["storage"] == "dense"
    assert io.arff_header(spark, str(tmp_path / "in.json"))["num-attributes"] == 4
    lines = sorted(r[0] for r in c.select(io.arff_line()).collect())
    assert lines == ['[["d1",["05C10","11"]],{"0":1,"3":2}]', '[["d2",[]],{"0":0.5,"2":1}]']
    io.write_arff_json(c, str(tmp_path / "out"), "c", 4)
    assert io.read_arff_json(spark, str(tmp_path / "out")).count() == 2 and io.arff_header(spark, str(tmp_path / "out"))["relation-name"] == "c"
    with_sources = c.withColumn("included_sources", F.array(F.when(F.col("id") == "d1", "zbmath metadata").otherwise("x")))
    io.write_arff_json(with_sources, str(tmp_path / "some"), "c", 4, "zbmath metadata")
    assert [r["id"] for r in io.read_arff_json(spark, str(tmp_path / "some")).collect()] == ["d1"]
    assert io.corpus_matrix(c, lambda d: d.filter("id = 'd2'")).count() == 2
    names, a = io.to_array(c, 4)
    assert a[names.index("d1")].tolist() == [1, 0, 0, 2]


def test_other_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("zeta\nalpha\n")
    assert {r["line"]: r["idx"] for r in io.numbered_lines(spark, str(tmp_path / "d.txt")).collect()} == {"zeta": 0, "alpha": 1}
    (tmp_path / "s.json").write_text("x\ny\nz\n" + json.dumps(["1", "Té", "A"]) + "\n")
    assert [tuple(r) for r in io.read_simple_corpus(spark, str(tmp_path / "s.json")).collect()] in ([("1", "T", "A")], [("1", "Té", "A")])
    clusters = spark.createDataFrame([("d;1"[:1] + "1", 0), ("d2", 1)], "doc_id string, cluster int")
    io.write_clusters(clusters, str(tmp_path / "c"))
    assert {tuple(r) for r in io.read_clusters(spark, str(tmp_path / "c")).collect()} == {("d1", 0), ("d2", 1)}
    chi = spark.createDataFrame([("05", 1, 2.5, 0.1), ("05", 2, 3.5, 0.05), ("11", 0, 1.0, 0.3)], "class string, idx int, score double, p double")
    io.write_chi(chi, str(tmp_path / "chi"), 1)
    assert {tuple(r) for r in io.read_chi(spark, str(tmp_path / "chi")).collect()} == {("05", 2, 3.5, 0.05), ("11", 0, 1.0, 0.3)}
    m = spark.createDataFrame([(0, 1, 2.0)], "row_id long, col int, value double")
    io.save_matrix(m, str(tmp_path / "m"))
    assert [tuple(r) for r in io.load_matrix(spark, str(tmp_path / "m")).collect()] == [(0, 1, 2.0)]


def test_artifacts(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for config in (Config(), Config(), Config(force_gen=True)):
        assert io.artifact(spark, str(tmp_path), Setting(), "x", make, config).count() == 3
    assert len(made) == 2
    df = spark.range(1000).withColumn("k", F.col("id").cast("string"))
    part = io.hash_sample(df, "k", 0.1)
    assert 60 < part.count() < 140 and part.count() == io.hash_sample(df.repartition(7), "k", 0.1).count()
