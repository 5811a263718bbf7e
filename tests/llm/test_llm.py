"""Operators of the subpackage against brute force on small data, and their defined cases."""

import collections
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathquarry.llm import cluster, encode, names, neardup, ngrams, pack, queries, split, tokenizer, words

# ---------------------------------------------------------------- words


def test_words():
    assert words.words("The <FID S1.p1> ﬁne­ness of x_1 Ａ1 naïve a") == ["the", "fineness", "of", "a1", "naïve"]
    assert words.words("a<fid q>b cd<Fid\nx>ef") == ["cd", "ef"]
    assert words.words(None) == words.words("") == words.words("N. N.") == []
    assert words.words("&lt;fid S1&gt;") == ["lt", "fid", "s1", "gt"]


def test_content_terms():
    x = '<m:math xmlns:m="urn:x"><m:apply><m:plus/><m:ci type="real"> x </m:ci><!-- c --><m:cn>&#x33;</m:cn><m:ci/></m:apply></m:math>'
    assert words.content_terms(x) == ["opr:plus", "sym:x", "num:3"]
    assert words.content_terms("<math><apply><ci>f</ci><apply><plus/></apply></apply></math>") == ["opr:ci", "sym:f", "opr:plus"]
    for bad in (None, "", " ", "<math><ci>x</math>", "<math><ci>a & b</ci></math>", "x"):
        assert words.content_terms(bad) == []


# ---------------------------------------------------------------- problem 1


def paragraphs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        topic = i % 12
        vocabulary = [f"topic{topic}word{j}" for j in range(25)]
        rows.append((f"d{i % 7}", f"p{i}", " ".join(rng.sample(vocabulary, 12) + ["the", "of"])))
    mixed = " ".join([f"topic0word{j}" for j in range(10)] + [f"topic1word{j}" for j in range(10)])
    rows += [("x", "mixed", mixed), ("x", "null", None), ("x", "empty", ""), ("x", "none", "zzzz yyyy"), rows[0], rows[0], (None, None, rows[1][2])]
    return spark.createDataFrame(rows, "document string, paragraph_id string, text string")


def test_clusters(spark):
    v = cluster.vectors_of(paragraphs(spark).withColumns({c: F.lit(1) for c in ("cells", "cluster", "node")}), "document", "paragraph_id")
    assert v.count() == 605
    tree = cluster.bisect(v, cluster.Limits(tight=0.65))
    got = {(r["document"], r["paragraph_id"]): r["cluster"] for r in cluster.assign(v, tree).collect()}
    assert len(got) == 603  # texts without words are in no cluster
    by_topic = collections.defaultdict(collections.Counter)
    for (_, p), c in got.items():
        if p and p[0] == "p":
            by_topic[int(p[1:]) % 12][c] += 1
    mains = {t: c.most_common(1)[0][0] for t, c in by_topic.items()}
    assert len(set(mains.values())) == 12 and all(c.most_common(1)[0][1] == 50 for c in by_topic.values())
    assert sum(tree.sizes[n] for n in tree.leaves()) == 603
    examples = {7: "topic0word1 topic0word2 topic0word3", 8: "topic2word1 topic2word5 topic2word9", 9: "nothing of this"}
    found = {(r[0], r[1]): r[2] for r in cluster.belongs(v, tree, cluster.subjects(tree, examples)).collect()}
    assert all(found.get(("d0" if i % 7 == 0 else f"d{i % 7}", f"p{i}")) == {0: 7, 2: 8}.get(i % 12) for i in range(600))
    assert ("x", "mixed") not in found and ("x", "none") not in found
    near = cluster.nearest(cluster.assign(v, tree), 2, "document", "paragraph_id").groupBy("cluster").count().collect()
    assert all(r["count"] <= 2 for r in near)


def test_clusters_of_few(spark):
    empty = spark.createDataFrame([], "document string, paragraph_id string, text string")
    v = cluster.vectors_of(empty, "document", "paragraph_id")
    assert cluster.bisect(v).leaves() == [] and cluster.assign(v, cluster.bisect(v)).count() == 0
    same = cluster.vectors_of(spark.createDataFrame([("d", str(i), "one two three") for i in range(50)], "document string, paragraph_id string, text string"), "document", "paragraph_id")
    assert len(cluster.bisect(same).leaves()) <= 1  # words of all records weigh nothing


def dominated(copies: bool):
    """A third of the rows on one subject, or copies of one text, beside six smaller subjects."""
    rng = random.Random(3)
    vocabulary = lambda t: [f"topic{t}word{j}" for j in range(25)]
    text = lambda t: " ".join(rng.sample(vocabulary(t), 12) + rng.sample(FILLER, 8))
    standing = " ".join(vocabulary(0)[:12] + FILLER[:4])
    return [("d", f"p{i}", standing if copies and i % 3 == 0 else text(0 if i % 3 == 0 else 1 + i // 3 % 6)) for i in range(1800)]


FILLER = [f"filler{j}" for j in range(14)]


@pytest.mark.parametrize("copies", [False, True])
def test_a_third_of_the_rows_is_a_cluster(spark, copies):
    v = cluster.vectors_of(spark.createDataFrame(dominated(copies), "document string, paragraph_id string, text string"), "document", "paragraph_id")
    tree = cluster.bisect(v)
    examples = {t: " ".join(f"topic{t}word{j}" for j in range(10)) for t in range(7)}
    found = {int(r["paragraph_id"][1:]): r["exemplar_id"] for r in cluster.belongs(v, tree, cluster.subjects(tree, examples)).collect()}
    assert found == {i: 0 if i % 3 == 0 else 1 + i // 3 % 6 for i in range(1800)}


def test_fewer_than_ten_records_have_leaves(spark):
    for n in (1, 5, 50):
        v = cluster.vectors_of(spark.createDataFrame([("d", str(i), "one two three") for i in range(n)], "document string, paragraph_id string, text string"), "document", "paragraph_id")
        tree = cluster.bisect(v)
        assert [tree.sizes[x] for x in tree.leaves()] == [n]
        assert {r["cosine"] for r in cluster.assign(v, tree).collect()} == {1.0}


def test_copies_of_few_texts_are_split(spark):
    rows = [("d", str(i), " ".join(f"text{i % 8}word{j}" for j in range(10))) for i in range(4000)]
    v = cluster.vectors_of(spark.createDataFrame(rows, "document string, paragraph_id string, text string"), "document", "paragraph_id")
    tree = cluster.bisect(v, cluster.Limits(sample=40))
    assert sorted(tree.sizes[n] for n in tree.leaves()) == [500] * 8
    drawn = [bytes(r["cells"]) for r in cluster._sampled(v.select(F.lit(0).alias("node"), F.xxhash64(*v.columns).alias("pick"), "cells"), {0: 4000}, 40).collect()]
    assert 10 < len(drawn) < 80 and len(set(drawn)) > 1


def test_a_small_node_of_a_large_table_is_split(spark):
    """The last node, two texts of 24 rows each, is under a thousandth of the table."""
    sizes = [35_000, 10_000, 3_000, 900, 270, 80, 24, 24]
    rows = [("d", f"{t}-{i}", " ".join(f"text{t}word{j}" for j in range(10))) for t, n in enumerate(sizes) for i in range(n)]
    v = cluster.vectors_of(spark.createDataFrame(rows, "document string, paragraph_id string, text string"), "document", "paragraph_id")
    tree = cluster.bisect(v, cluster.Limits(block=1))
    assert sorted((tree.sizes[n] for n in tree.leaves()), reverse=True) == sizes


def test_exemplars_of_chained_leaves_keep_their_groups():
    """Leaves of two subjects and one of paragraphs that deal with both alike."""
    own = [cluster.cells_of(" ".join(f"subject{t}word{j}" for j in range(20))) for t in range(2)]
    sums = np.zeros((3, cluster.CELLS))
    sums[0, own[0]], sums[1, own[1]] = 10.0, 9.0
    sums[2, own[0]], sums[2, own[1]] = 3.0, 3.1
    tree = cluster.Tree(np.ones(cluster.CELLS), {0: 100, 1: 90, 2: 30}, {0: 0.5, 1: 0.5, 2: 0.5}, dict(enumerate(sums)))
    centres = cluster.unit(sums)
    assert centres[0] @ centres[1] < 0.1 and min(centres[2] @ centres[0], centres[2] @ centres[1]) > 0.5
    got = cluster.subjects(tree, {t: " ".join(f"subject{t}word{j}" for j in range(12)) for t in range(2)})
    assert {e for e in got.exemplars if e is not None} == {0, 1}
    for t in range(2):
        g = got.exemplars.index(t)
        assert got.weights[:, own[t]].sum(axis=1).argmax() == g


def test_bisection_cuts_on_rows_of_a_batch():
    import pyarrow as pa

    blobs = [np.array(x, dtype="<u2").tobytes() for x in ([1, 2], [], [2, 3])]
    rows = cluster.Rows(pa.array([b"", *blobs], pa.binary()).slice(1), np.array([0, 1.0, 1.0, 2.0] + [0.0] * (cluster.CELLS - 4)))
    assert rows.counts.tolist() == [2, 0, 2] and np.allclose(rows.add(rows.value**2), [1, 0, 1])


# ---------------------------------------------------------------- problem 2


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngrams(spark, sigma):
    rng = random.Random(sigma)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "aa " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    got = {tuple(r["ngram"].split(ngrams.MARK)) if r["n_terms"] else (): (r["n_occurrences"], r["n_records"]) for r in ngrams.ngram_counts(df, words.words, sigma).collect()}
    occurrences, records = collections.Counter(), collections.Counter()
    for t in texts:
        w = words.words(t)
        grams = [tuple(w[i : i + n]) for n in range(1, sigma + 1) for i in range(len(w) - n + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    assert got.pop(()) == (len(texts), len(texts))
    assert got == {g: (occurrences[g], records[g]) for g in occurrences}
    assert ngrams.ngram_counts(df.limit(0), words.words, sigma).count() == 0


# ---------------------------------------------------------------- problem 3


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_segments_meet_within_distance():
    """Whatever ``distance`` takes for a spelling is looked up, swaps over borders of segments included."""
    rng = random.Random(5)
    met = 0
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(b) + 1)
            edit = rng.choice("irst")
            if edit == "i":
                b.insert(i, rng.choice("abc"))
            elif edit == "t":
                b[i : i + 2] = b[i : i + 2][::-1]
            elif b and i < len(b):
                b[i : i + 1] = [] if edit == "r" else [rng.choice("abc")]
        b = "".join(b)
        k = names.edits(len(a))
        if b and names.distance(b, a, k) <= k:
            met += 1
            assert set(names.indexed(a)) & names.looked_up(b), (a, b)
    assert met > 3000
    assert set(names.indexed("hoffmann")) & names.looked_up("hfofmaxn")


def test_distance():
    assert names.distance("abcd", "abdc", 2) == 1 and names.distance("abc", "abc", 0) == 0 and names.distance("abc", "xyz", 2) == 3
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in "ab")
        d = names.distance(a, b, 3)
        assert d <= min(4, levenshtein(a, b)) and (d < 4 or levenshtein(a, b) > 3)


PROFILES = [
    ("w.m", "Wirnakard, Michael"), ("w.mi", "Wirnakard, Mikhail"), ("k.m-e", "van der Khethquukwick, Margaret E."), ("s.k", "Suldzhirü, Katharina"), ("g.s", "Grithkhurnü, Søren"),
    ("o.b", "Brenfeld Number Collaboration"), ("o.q", "Quillon Symmetry Study Circle"), ("d.1", "Doppelmann, Anna"), ("d.2", "Doppelmann, Anna"), ("n", None), ("e", ""),
]
SPELLINGS = {
    "Michael Wirnakard": "w.m", "Wirnakard, Mike": "w.m", "Misha Wirnakard": "w.mi", "M. Wirnakard": None, "Wirnakrad Michael": "w.m", "MICHAEL WIRNAKARD (ed.)": "w.m", "Prof. Michael Wirnakard 1)": "w.m",
    "Khethquukwick, Margaret E. van der": "k.m-e", "M.~E. van der Khethquukwick": "k.m-e", "P. van der Khethquukwick": None, "Peggy Khetquukwick": "k.m-e", "K. Suldzhirue": "s.k", "Suldzhiru Katja": "s.k", "S. Grithkhurnu": "g.s",
    "Grithkhurnü": None, "BNC": "o.b", "Collaboration (Brenfeld Number)": "o.b", "The Brenfeld Numb. Collaboration": "o.b", "QSSC": "o.q", "Q.S.S.C.": "o.q", "Quillon-Symmetry Stu. Cir.": "o.q", "Anna Doppelmann": None,
    "Wіrnakard, Michael": "w.m", "et al.": None, "N. N.": None, "(anonymous)": None, " ": None, "": None, "x" * 5000: None,
}


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_links(spark, monkeypatch, broadcast):
    monkeypatch.setattr(names, "BROADCAST_SEGMENTS", broadcast)
    typed = spark.createDataFrame([(n, 1) for n in SPELLINGS for _ in "ab"] + [(None, 1)], "name string, id int")
    dictionary = spark.createDataFrame(PROFILES, "id string, preferred string")
    got = {r["name"]: r["id"] for r in names.link_names(typed.select("name"), dictionary).collect()}
    want = {n: i for n, i in SPELLINGS.items() if i}
    want.pop("Grithkhurnü", None)
    assert got == want
    assert names.link_names(typed.limit(0).select("name"), dictionary).count() == 0
    assert names.link_names(typed.select("name"), dictionary.limit(0)).count() == 0


def test_links_of_labelled_rows(spark, data):
    """Rows with an id serve as held-out cases: hardly any is missed, none is wrong but by a tie."""
    rows = spark.read.parquet(f"{data}/authorship.parquet").filter("trim(zbmath_id) <> ''").select(F.col("display_name").alias("name"), F.lower(F.trim("zbmath_id")).alias("want")).distinct()
    profiles = spark.read.parquet(f"{data}/author_profile.parquet").select(F.col("zbmath_id").alias("id"), F.col("preferred_name").alias("preferred"))
    got = rows.join(names.link_names(rows.select("name"), profiles), "name", "left").collect()
    right = sum(r["id"] == r["want"] for r in got)
    assert right >= 0.9 * len(got) and sum(r["id"] is not None and r["id"] != r["want"] for r in got) <= 0.005 * len(got)


# ---------------------------------------------------------------- problem 5


def near_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        base = rng.sample(vocabulary, rng.randint(1, 25))
        texts.append(base)
        for _ in range(rng.randint(0, 2)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rng.shuffle(other)
            texts.append(other + ["word0"] * rng.randint(0, 1))
    rows = [("f", f"k{i}", " ".join(t)) for i, t in enumerate(texts)]
    rows += [("g", "k0", " ".join(texts[0])), ("f", "null", None), ("f", "empty", ""), ("f", "no", "a . b"), rows[0], ("f", None, " ".join(texts[0])), ("f", "long", "word1 " * 20_000)]
    return rows


def brute_pairs(rows):
    sets = {(f, k): frozenset(words.words(t)) for f, k, t in rows if k is not None}
    keys = sorted(k for k, s in sets.items() if s)
    return {(f, a, b) for i, (f, a) in enumerate(keys) for g, b in keys[i + 1 :] if f == g and 5 * len(sets[f, a] & sets[g, b]) >= 4 * len(sets[f, a] | sets[g, b])}


@pytest.mark.parametrize("hot", [0.05, 0.4, 200])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    rows = near_texts(int(hot * 20))
    df = spark.createDataFrame(rows, "field string, key string, text string").withColumn("size", F.lit("clash")).repartition(4)
    sets = neardup.word_sets(df)
    got = [tuple(r) for r in neardup.record_pairs(sets).collect()]
    want = brute_pairs(rows)
    assert len(got) == len(set(got)) and set(got) == want
    groups = neardup.groups(sets).filter("key is not null").collect()
    degree = collections.Counter(k for f, a, b in want for k in ((f, a), (f, b)))
    own = {(r["field"], r["key"]): r for r in groups}
    assert len(own) == len(groups)
    extra = own["f", "k0"]["class_id"]  # the record without a key counts as a copy
    assert all(r["n_links"] == degree[k] + (r["class_id"] == extra or any((k[0], *sorted((k[1], o))) in want for f, o in own if f == k[0] and own[f, o]["class_id"] == extra)) for k, r in own.items())
    for f, a, b in want:
        assert own[f, a]["group_id"] == own[f, b]["group_id"]


def test_near_duplicates_among_long_texts(spark):
    """Sets of a thousand words, where few words are rare."""
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(1500)]
    rows = []
    for i in range(12):
        base = rng.sample(vocabulary, 1000)
        rows += [("f", f"{i}-{j}", " ".join(base[: 1000 - 40 * j] + [f"new{i}x{x}" for x in range(40 * j)])) for j in range(5)]
    sets = neardup.word_sets(spark.createDataFrame(rows, "field string, key string, text string"))
    want = brute_pairs(rows)
    assert want and {tuple(r) for r in neardup.record_pairs(sets).collect()} == want


def test_null_keys(spark):
    text = "one two three four five"
    rows = [(None, "a", text), (None, "b", text), ("f", None, text), ("f", "b", text), ("f", "b", text)]
    sets = neardup.word_sets(spark.createDataFrame(rows, "field string, key string, text string"))
    assert [tuple(r) for r in neardup.record_pairs(sets).collect()] == [(None, "a", "b")]
    assert sorted((r["field"] or "", r["key"] or "", r["n_links"]) for r in neardup.groups(sets).collect()) == [("", "a", 1), ("", "b", 1), ("f", "", 1), ("f", "b", 1)]
    big = "abc def. " * 900
    docs = spark.createDataFrame([(None, big), (None, None), (1, big), (None, big)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"]) > 0) for r in encode.encode_corpus(docs).collect()) == [(0, False), (0, True), (0, True), (1, True)]
    assert pack.pack(spark.createDataFrame([(None, 5), (None, 5), (1, None)], "doc_id long, n_tokens long"), 10).count() == 3
    assert split.split_oversized(docs, 100, 10).select("doc_id").distinct().count() == 2


def test_no_near_duplicates(spark):
    none = neardup.word_sets(spark.createDataFrame([("f", "a", None)], "field string, key string, text string"))
    assert neardup.record_pairs(none).count() == 0 and neardup.groups(none).count() == 0
    with pytest.raises(ValueError):
        neardup.candidates(none, (1, 2))


# ---------------------------------------------------------------- problems 6 to 8

TEXTS = [None, "", " ", "\n\n", "a", "it's 'stop'", "don’t   stop\r\n\r\n x", "中文" * 900, "x" * 9000, " " * 3000 + "y", "<|endoftext|> é́​", "Ａbc１２ ½", "word " * 3000, "!" * 2500]


def documents(spark, seed=0):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abc .,\n'") for _ in range(4000)) for _ in range(4)]
    texts = TEXTS + ["".join(rng.sample(shared, rng.randint(1, 3))) + str(i) for i in range(30)] + [shared[0]] * 5
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(0, None, "clash", 0), (1000, shared[0], "clash", 1), (1000, shared[0], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, seq int").repartition(3)


def test_encoding_is_that_of_whole_texts(spark):
    enc = tokenizer.encoder()
    docs = documents(spark)
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode.encode_corpus(docs).collect())
    assert got == sorted((r["doc_id"], enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert encode.encode_corpus(docs.limit(0)).count() == 0


def test_only_shared_chunks_count_as_shared(spark):
    """Whatever the size of the corpus, a text is told to share what occurs twice, and nothing else."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(3000))
    common, own = text() * 2, [text() for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(own)] + [(400, common), (401, own[0] + "x"), (402, None), (403, ""), (404, "a"), (405, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.unhex(F.md5("text")))
    got = {r["doc_id"]: set(r["shared"]) for r in encode.sharing(docs).join(docs, "key").collect()}
    assert set(got) == {0, 400, 401, 404, 405}
    assert got[0] == got[401] and len(got[0]) < len(encode.cut_positions([own[0]])[0]) + 1


def test_repaired_joins():
    enc = tokenizer.encoder()
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab '  \n\t.,中é1２s'tll") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 5)))
        parts = [encode.encode_parts(text[a:b], enc) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert encode.join_parts(parts, enc) == enc.encode_ordinary(text)


def test_cuts_depend_on_content():
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    a, b = encode.cut_positions([body, "other beginning " + body, "", "x"])[:2]
    assert len(a) > 5 and {x + 16 for x in a[1:]} & set(b) >= {x + 16 for x in a[3:]}
    assert encode.cut_positions(["", "x"]) == [[0], [1]]


def check_packing(lengths, capacity, rows):
    """Every item is placed whole or, if it exceeds the capacity, in pieces; containers aren't overfull nor places taken twice."""
    by_doc, by_container = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_container[r["container"]].append(r)
    for d, n in lengths.items():
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        n = max(n or 0, 0)
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["n_tokens"] for r in mine) == n
        assert len(mine) == max(1, -(-n // capacity))
    for held in by_container.values():
        held.sort(key=lambda r: r["place"])
        assert [r["place"] for r in held if r["n_tokens"]] == list(range(sum(r["n_tokens"] > 0 for r in held)))
        assert len({r["place"] for r in held}) == len(held)
        assert [r["start"] for r in held] == [sum(x["n_tokens"] for x in held[:i]) for i in range(len(held))] and sum(r["n_tokens"] for r in held) <= capacity
    assert sorted(by_container) == list(range(len(by_container)))


@pytest.mark.parametrize("capacity,seed", [(10, 0), (64, 1), (100, 2), (2048, 3)])
def test_packing(spark, capacity, seed):
    rng = random.Random(seed)
    lengths = {i: rng.choice([0, rng.randint(1, capacity), rng.randint(1, 3 * capacity), max(1, capacity // 3)]) for i in range(800)} | {900: None, 901: -5}
    df = spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long").withColumn("rank", F.lit("clash"))
    rows = pack.pack(df, capacity).collect()
    check_packing(lengths, capacity, rows)
    total = sum(max(n or 0, 0) for n in lengths.values())
    assert len({r["container"] for r in rows}) <= 1.02 * total / capacity + 2


def test_packing_of_few(spark):
    df = spark.createDataFrame([(i, 0) for i in range(25)], "doc_id long, n_tokens long")
    check_packing({i: 0 for i in range(25)}, 10, pack.pack(df, 10).collect())
    assert pack.pack(df.limit(0), 10).count() == 0
    # pairs and triples that fill exactly are found
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40, 50, 30, 20]] = [3, 3, 1, 1, 1]
    assert sorted(pack.exact_patterns(counts, 100)) == [(1, [50, 30, 20]), (3, [60, 40])] and not counts.any()


def test_splitting(spark):
    enc = tokenizer.encoder()
    docs = documents(spark).filter("doc_id <> 1000")
    rows = split.split_oversized(docs, 100, 16).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for d in docs.collect():
        n = len(enc.encode_ordinary(d["text"] or ""))
        mine = sorted(pieces.get(d["doc_id"], []), key=lambda r: r["piece"])
        assert bool(mine) == (n > 100)
        if mine:
            assert "".join(r["text"][r["new_from"] - r["char_start"] :] for r in mine) == d["text"]
            assert all(r["n_tokens"] <= 100 and r["text"] == d["text"][r["char_start"] : r["char_end"]] for r in mine)
            assert mine[0]["n_repeated"] == 0 and all(0 < r["n_repeated"] <= 16 for r in mine[1:]) and all(a["char_end"] == b["new_from"] for a, b in zip(mine, mine[1:]))
            assert all(r["n_repeated"] >= 12 for r in mine[1:] if unicodedata.normalize("NFKC", d["text"]).isascii())
    assert {r["boundary"] for r in rows} == {"sentence", "paragraph", "word", "token", "end"} - ({"paragraph"} - {r["boundary"] for r in rows})
    assert split.split_oversized(docs.limit(0), 100, 16).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(docs, 16, 12)


def test_pointer_doubling():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(2, 60)
        nxt = np.array([min(n - 1, i + rng.randint(1, 5)) for i in range(n)])
        at, want = 0, {0}
        while at != n - 1:
            at = int(nxt[at])
            want.add(at)
        assert set(np.flatnonzero(split.reachable(nxt, np.array([0])))) == want


# ---------------------------------------------------------------- registered queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


FOUND = {
    "p1_found": "document string, paragraph_id string, exemplar_id int", "p2_found": "field string, term string, mark string", "p3_found": "document string, rank int, zbmath_id string",
    "p5_found": "field string, key_a string, key_b string", "p6_ids": "doc_id bigint, ids array<int>",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, data, name):
    assert ", ".join(" ".join(c) for c in queries.queries()[name](spark, data).dtypes) == FOUND[name]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, data, name):
    from tests.oracle import compare, duck

    assert compare(spark, data, name, duck(data)) is None
