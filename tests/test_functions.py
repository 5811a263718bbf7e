import math
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mathquarry.functions import formula, ids, review, text

A = "<math><apply><plus/><ci>x</ci><cn>1</cn></apply></math>"
B = "<math><ci>x</ci></math>"
C = "<math><apply><eq/><apply><power/><ci>a</ci><cn>2</cn></apply><ci>b</ci></apply></math>"


def test_kristianto():
    assert formula.kristianto(A) == "o:1#plus o:plus o:2#ci#x o:ci#x o:3#cn#1 o:cn#1 u:#plus u:plus u:#ci#x u:ci#x u:#cn#1 u:cn#1 s:plus-ci#x s:plus-cn#1 s:ci#x-cn#1".split()
    assert formula.kristianto(B) == []
    want = "o:1#eq o:eq o:2#1#power o:1#power o:power o:2#2#ci#a o:2#ci#a o:ci#a o:2#3#cn#2 o:3#cn#2 o:cn#2 o:3#ci#b o:ci#b "
    want += "u:#eq u:eq u:##power u:#power u:power u:##ci#a u:#ci#a u:ci#a u:##cn#2 u:#cn#2 u:cn#2 u:#ci#b u:ci#b s:power-ci#a s:power-cn#2 s:ci#a-cn#2"
    assert formula.kristianto(C) == want.split()


def test_lin():
    assert formula.lin(A) == ["math(apply(plus#ci(x)>cn(1)))", "apply(plus#ci(x)>cn(1))", "ci(x)", "cn(1)", "apply(plus>ci()>cn())", "math(apply(plus))"]
    assert formula.lin(B) == ["math(ci(x))", "ci(x)", "math(ci())"]
    assert formula.lin(C) == [
        "math(apply(eq#apply(power#ci(a)>cn(2))>ci(b)))", "apply(eq#apply(power#ci(a)>cn(2))>ci(b))", "apply(power#ci(a)>cn(2))", "ci(a)", "cn(2)", "apply(power>ci()>cn())", "ci(b)", "apply(eq>apply(power)>ci())", "math(apply(eq))",
    ]
    assert all(len(t) <= 20 for t in formula.lin(C, 20)) and formula.lin("<math><ci>" + "x" * 300 + "</ci></math>") == ["math(ci())"]


def test_content_and_malformed():
    assert formula.content_features(A) == ["opr:plus", "sym:x", "num:1"]
    assert sorted(formula.content_features(C)) == ["num:2", "opr:eq", "opr:power", "sym:a", "sym:b"]
    for f in (formula.kristianto, formula.lin, formula.content_features):
        assert f(None) == f("") == f("<math><ci>x</math>") == f("a & b") == []


def test_formula_table_function(spark):
    df = spark.createDataFrame([("d", "1", A), ("d", "1", A), ("d", None, None)], "document string, tokens_ string, c_math_ml string")
    got = formula.formula_tokens(df, "content").collect()
    assert [r["tokens"] for r in got] == [["opr:plus", "sym:x", "num:1"]] * 2 + [[]]
    assert formula.formula_tokens(df.limit(0), "lin").count() == 0
    with pytest.raises(ValueError):
        formula.formula_tokens(df, "other")


def test_latex(spark):
    raw = r"\frac{a}{b_1} + \, \alpha^2\{x\} " + "\\"
    got = spark.createDataFrame([(raw,), (None,), ("",), ("\\\n",)], "t string").select(text.latex_tokens(F.col("t")).alias("t")).collect()
    assert got[0]["t"] == "$frac$ $a$ $b$ $_$ $1$ $+$ $,$ $alpha$ $^$ $2$ ${$ $x$ $}$".split()
    assert [got[1]["t"], got[2]["t"], got[3]["t"]] == [[], [], ["$\n$"]]


def test_words(spark):
    df = spark.createDataFrame([("Die Äpfel der Problems a x_1 models",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.word_tokens(F.col("t"), "t:")).collect()]
    assert got == [["t:die", "t:äpfel", "t:der", "t:problems", "t:x_1", "t:models"], [], []]
    stopped = df.select(text.word_tokens(F.col("t"), "", text.noun_lemmatizer({"problem", "model"}), text.REVIEW_STOP_WORDS)).first()[0]
    assert stopped == ["die", "äpfel", "der", "x_1"]


def test_lemmas_and_stems():
    assert [text.singular(w, {"property", "matrix", "class", "box"}) for w in ("properties", "classes", "class", "boxes", "gas")] == ["property", "class", "class", "box", "gas"]
    assert [text.singular(w) for w in ("vertices", "properties", "basis", "class")] == ["vertice", "property", "basis", "class"]
    words = "caresses ponies relational conditional hopping falling filing happy sky generalizations oscillators agreed plastered motoring sized".split()
    assert [text.porter(w) for w in words] == "caress poni relat condit hop fall file happi sky gener oscil agre plaster motor size".split()


def test_mixed_and_sentences(spark):
    df = spark.createDataFrame([("Let <fid F1> be big. Then <fid F2>",), ("",), (None,)], "t string")
    parts = [[tuple(p) for p in r[0]] for r in df.select(text.mixed_parts(F.col("t"))).collect()]
    assert parts[0] == [(0, "text", "Let "), (1, "formula", "F1"), (2, "text", " be big. Then "), (3, "formula", "F2"), (4, "text", "")]
    assert parts[1] == parts[2] == [(0, "text", "")]
    s = [r[0] for r in df.select(text.sentence_tokens(F.col("t"))).collect()]
    assert s == [[["let", "<fid F1>", "be", "big"], ["then", "<fid F2>"]], [], []]
    assert df.limit(1).select(text.dump_paragraph(text.sentence_tokens(F.col("t")))).first()[0] == "let <fid F1> be big. then <fid F2>"
    m = df.limit(1).select(text.inline_formulas(F.flatten(text.sentence_tokens(F.col("t"))), F.create_map(F.lit("F1"), F.lit("x")))).first()[0]
    assert m == ["let", "$x$", "be", "big", "then"]
    d = spark.createDataFrame([("the set $x+1$ holds $\\{$",)], "t string").select(text.dollar_tokens(F.col("t"), text.REVIEW_STOP_WORDS)).first()[0]
    assert d == ["set", "x1", "holds"]


def test_characters(spark):
    df = spark.createDataFrame([("a\x00é​",)], "t string")
    assert df.select(text.ascii_escape("t")).first()[0] == "a&#233;&#8203;"
    assert df.select(text.printable(F.col("t"))).first()[0] == "a"
    tok = spark.createDataFrame([(["$x$", "$", "a$", "$$"],)], "t array<string>")
    assert tok.select(text.formula_tokens(F.col("t"))).first()[0] == ["$x$", "$$"]


REVIEW = r"this is a test (TIAT) $asdfasdf$ {\it Grubel, Bert} TIAT is cool [zbl asdfasdf 1000.1000]"


def test_review(spark):
    tokens = [t for t in review.review_token_list(REVIEW) if t["kind"] != "blank"]
    assert [t["text"] for t in tokens] == "this is a test asdfasdf Grubel Bert this is a test is cool".split() + ["zbl asdfasdf 1000.1000"]
    assert tokens[-1]["number"] == "1000.1000"
    assert [k for k, _ in review.scan("$$x$$ [a [b] c] [open $a (x")] == ["formula", "blank", "reference", "blank", "string", "blank", "string", "blank", "braced"]
    assert review.review_token_list(None) == review.review_token_list("") == []
    df = spark.createDataFrame([(REVIEW,)], "t string")
    assert "$asdfasdf$" in df.select(review.surface(review.review_tokens("t"))).first()[0]
    got = df.select(review.normalized(["a"])(review.review_tokens("t"))).first()[0]
    assert got == ["thi", "is", "test", "$asdfasdf$", "{Grubel}", "{Bert}", "thi", "is", "test", "is", "cool"]


def test_review_kinds_are_counted(spark):
    """As the token lists say, texts without tokens included."""
    texts = [REVIEW, None, "", "[Zbl 1.2] [no number] (AB) a, b", "$x", REVIEW + " (x"]
    want = Counter(t["kind"] for x in texts for t in review.review_token_list(x))
    numbers = Counter(t["kind"] for x in texts for t in review.review_token_list(x) if t["number"])
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    got = review.kind_counts(df)
    assert got.dtypes == [("kind", "string"), ("n", "bigint"), ("n_numbers", "bigint")]
    assert {r["kind"]: (r["n"], r["n_numbers"]) for r in got.collect()} == {k: (n, numbers[k]) for k, n in want.items()}
    assert review.kind_counts(df.filter("text = ''")).collect() == []


def test_review_kinds_hold_one_text(spark):
    """The tokens of a batch of texts aren't held together: these 500,000 took 96 MB as lists."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a b, " * 100] * 1000)], names=["text"])
    tracemalloc.start()
    (counted,) = review.count_kinds(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counted.column("n").to_pylist()) == 500_000 and peak < 2 << 20


PARAGRAPH_IDS = {
    "p3": ("top_level_paragraph", None), "s1.p2": ("section_paragraph", None), "s1.ss2.p3": ("section_paragraph", None), "s1.thmtheorem2.p1": ("section_paragraph", None), "a1.p1": ("section_paragraph", None),
    "ch1.i1.i2.p1": ("section_paragraph", None), "i1.i2.p3": ("itemize", None), "id7": ("id", None), "thmtheorem2.p1": ("theorem", "theorem"), "thmthm1.1.p1": ("theorem", "theorem"), "thmlemma3.p2": ("theorem", "lemma"),
    "c1.thmlem2.p1": ("theorem", "lemma"), "thmcor2.p1": ("theorem", "corollary"), "thmdf1.p1": ("theorem", "df"), "thmass1.p1": ("theorem", "assuption"), "thmpropx1": ("theorem", "proposition"), "thm7": ("theorem", None), "xyz": (None, None), "": (None, None),
}


def test_paragraph_ids(spark):
    df = spark.createDataFrame([(k,) for k in PARAGRAPH_IDS] + [(None,)], "id string")
    got = {r[0]: (r[1]["type"], r[1]["theorem_type"]) for r in df.select("id", ids.parse_paragraph_id(F.col("id"))).collect()}
    assert got == PARAGRAPH_IDS | {None: (None, None)}
    longest = {r[0]: r[1] for r in df.select("id", ids.parse_paragraph_id(F.col("id"), "longest")).collect()}
    assert longest["s1.ss2.p3"]["type"] == "subsection_paragraph" and longest["s1.ss2.p3"]["subsection"] == "2"
    assert longest["s1.thmtheorem2.p1"]["theorem_type"] == "theorem" and longest["ch1.i1.i2.p1"]["type"] == "itemize"


def test_article_ids(spark):
    df = spark.createDataFrame([([("10.1/x(y)", "doi"), ("0704.0005", "arxiv")], 200), ([], 429)], "i array<struct<ident:string,source:string>>, s int")
    got = df.select(ids.first_doi(F.col("i")).alias("d"), ids.download_action(F.col("s")).alias("a"), ids.safe_file_name(ids.first_doi(F.col("i"))).alias("f")).collect()
    assert [tuple(r) for r in got] == [("10.1/x(y)", "save", "101xy"), (None, "wait and retry", None)]
    assert math.isfinite(1)
