"""Article XML: a streaming parse in Python around ordered mixed content.

An article is metadata followed by content.  Paragraphs are ``div`` elements at
depth three; formulas are ``math`` elements, whose presentation markup comes
first in ``semantics`` and whose content markup sits in ``annotation-xml``.
"""

from __future__ import annotations

import datetime as dt
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathquarry import schema
from mathquarry.functions.text import ascii_escape_text


class _Stop(Exception):
    pass


#: Where a metadata value comes from: the last elements of the path, and the field it is added to.
FIELDS = {
    ("identifiers", "id"): "identifiers",
    ("arxiv_title",): "title",
    ("arxiv_abstract",): "abstract",
    ("arxiv_publication_date",): "date",
    ("languages", "language"): "languages",
    ("authors", "author", "name"): "names",
    ("zb_author_identifiers", "author_identifier"): "idents",
    ("semantic_metadata", "arxiv", "cat"): "arxiv_cats",
    ("semantic_metadata", "zb_msc", "cat"): "zb_msc_cats",
}


class ArticleReader:
    """Collects one article; the text of an element is taken whole and trimmed once."""

    def __init__(self, metadata_only: bool = False):
        self.metadata_only = metadata_only
        self.path: list[str] = []
        self.texts: list[list[str]] = []
        self.attributes: list[dict] = []
        self.found: dict[str, list] = {f: [] for f in FIELDS.values()}
        self.sources: list[str] = []
        self.content: list[dict] = []
        self.math: dict | None = None
        self.run: list[str] = []

    def parse(self, xml: str | bytes) -> ArticleReader:
        p = expat.ParserCreate()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        try:
            p.Parse(xml, True)
        except _Stop:
            pass
        return self

    def part(self) -> str | None:
        return self.path[1] if len(self.path) > 1 else None

    def start(self, name: str, attributes: dict) -> None:
        self.path.append(name)
        self.texts.append([])
        self.attributes.append(attributes)
        if self.part() != "content":
            return
        if self.metadata_only:
            raise _Stop
        if self.math is None:
            self.flush()
            if name == "math":
                self.math = {"id": attributes.get("id"), "latex": attributes.get("alttext"), "where": "outside", "presentation": [], "content": []}
            elif name == "div" and len(self.path) == 3:
                self.add("paragraph", ident=ascii_escape_text(attributes.get("id")))
            return
        where = self.math["where"]
        if where == "outside" and name == "semantics":
            self.math["where"] = "presentation"
        elif where == "presentation" and name == "annotation-xml":
            self.math["where"] = "content"
        elif where in ("presentation", "content"):
            self.math[where].append(f"<{name}>")

    def end(self, name: str) -> None:
        text = "".join(self.texts.pop())
        attributes = self.attributes.pop()
        part, path = self.part(), tuple(self.path)
        self.path.pop()
        if part == "included_sources" and name == "source":
            self.sources.append(text.strip())
        elif part == "metadata":
            for tail, field in FIELDS.items():
                if path[-len(tail) :] == tail:
                    self.found[field].append((text.strip(), attributes.get("type")) if field == "identifiers" else text.strip())
        elif part == "content":
            self.end_content(name)

    def end_content(self, name: str) -> None:
        if self.math is None:
            self.flush()
            return
        where = self.math["where"]
        if where == "content" and name == "annotation-xml":
            self.math["where"] = "done"
        elif where in ("presentation", "content") and name not in ("math", "semantics"):
            self.math[where].append(f"</{name}>")
        if name == "math":
            m, self.math = self.math, None
            if m["id"] is not None:  # formulas without an id are dropped
                mark = lambda parts: f"<math>{''.join(parts)}</math>"
                self.add("formula", ident=ascii_escape_text(m["id"]), latex=ascii_escape_text(m["latex"]), p_math_ml=mark(m["presentation"]), c_math_ml=mark(m["content"]))

    def text(self, data: str) -> None:
        if self.texts:
            self.texts[-1].append(data)
        if self.part() != "content":
            return
        if self.math is None:
            self.run.append(data)
        elif self.math["where"] in ("presentation", "content"):
            self.math[self.math["where"]].append(ascii_escape_text(escape(data.strip())))

    def flush(self) -> None:
        run, self.run = "".join(self.run), []
        if run.strip():
            self.add("text", text=run)

    def add(self, kind: str, **values) -> None:
        self.content.append({"pos": len(self.content), "kind": kind, "ident": None, "text": None, "latex": None, "p_math_ml": None, "c_math_ml": None} | values)

    def row(self, path: str) -> dict:
        f = self.found
        names, idents = f["names"], f["idents"]
        paired = idents if len(names) == len(idents) else [None] * len(names)  # identifiers count only if there is one for each name
        date = None
        if f["date"]:
            try:
                date = dt.date.fromisoformat(f["date"][-1][:10])
            except ValueError:
                pass
        return {
            "path": path, "identifiers": [{"ident": i, "source": s} for i, s in f["identifiers"]], "title": " ".join(f["title"]) or None, "abstract": " ".join(f["abstract"]) or None,
            "languages": f["languages"], "included_sources": self.sources, "publication_date": date, "zb_msc_cats": f["zb_msc_cats"], "arxiv_cats": f["arxiv_cats"],
            "authors": [{"name": n, "ident": i} for n, i in zip(names, paired)], "content": self.content, "error": None,
        }


def parse_article(path: str, xml: str | bytes, metadata_only: bool = False) -> dict:
    """One article as a row; malformed XML gives a row with ``error`` and nothing else."""
    try:
        return ArticleReader(metadata_only).parse(xml).row(path)
    except (expat.ExpatError, ValueError) as e:
        return dict.fromkeys(schema.ARTICLE.names) | {"path": path, "error": str(e)}


def parse_articles(files: DataFrame, metadata_only: bool = False) -> DataFrame:
    """Articles of ``files`` (path, xml), one row for each; null or malformed XML has an error."""

    def run(batches):
        for pdf in batches:
            rows = [parse_article(p, x if x is not None else "", metadata_only) for p, x in zip(pdf["path"], pdf["xml"])]
            yield pd.DataFrame(rows, columns=schema.ARTICLE.names)

    return files.select("path", "xml").mapInPandas(run, schema.ARTICLE)


def read_articles(spark: SparkSession, paths: str | list[str], metadata_only: bool = False) -> DataFrame:
    """Parses article files below ``paths``; with ``metadata_only`` reading stops where the content begins."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return parse_articles(files, metadata_only)


def article_id(identifiers) -> F.Column:
    """The arXiv identifier; an article must have exactly one."""
    own = F.filter(identifiers, lambda x: x["source"] == "arxiv")
    return F.when(F.assert_true(identifiers.isNull() | (F.size(own) == 1), "an article must have exactly one arXiv id").isNull(), own[0]["ident"])


def paragraphs(articles: DataFrame) -> DataFrame:
    """(path, paragraph_id, text): texts with ``<fid ID>`` for formulas, joined by a blank.

    Text before the first paragraph mark belongs to the first paragraph; empty
    paragraphs are kept except at the end.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("open"), empty.alias("buffer"), F.array().cast("array<struct<paragraph_id:string,text:string>>").alias("done"))
    piece = lambda c: F.when(c["kind"] == "text", c["text"]).otherwise(F.concat(F.lit("<fid "), c["ident"], F.lit(">")))
    close = lambda acc: F.struct(acc["open"].alias("paragraph_id"), F.array_join(acc["buffer"], " ").alias("text"))

    def step(acc, c):
        closed = F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(close(acc)))).otherwise(acc["done"])
        kept = F.when(acc["open"].isNotNull(), empty).otherwise(acc["buffer"])
        new = c["kind"] == "paragraph"
        return F.struct(
            F.when(new, c["ident"]).otherwise(acc["open"]).alias("open"), F.when(new, kept).otherwise(F.concat(acc["buffer"], F.array(piece(c)))).alias("buffer"),
            F.when(new, closed).otherwise(acc["done"]).alias("done"),
        )

    end = lambda acc: F.when(acc["open"].isNotNull() & (F.size(acc["buffer"]) > 0), F.concat(acc["done"], F.array(close(acc)))).otherwise(acc["done"])
    return articles.filter("error is null").select("path", F.inline(F.aggregate("content", start, step, end)))


def formulas(articles: DataFrame) -> DataFrame:
    """(path, formula_id, latex, p_math_ml, c_math_ml) of the formulas with an id."""
    c = articles.filter("error is null").select("path", F.explode("content").alias("c")).filter("c.kind = 'formula'")
    return c.select("path", F.col("c.ident").alias("formula_id"), "c.latex", "c.p_math_ml", "c.c_math_ml")


def to_tables(articles: DataFrame) -> dict[str, DataFrame]:
    """The relational tables of parsed articles (document, formula, paragraph2, theorem, authorship, msc_assignment).

    ``rank`` and ``pos`` are positions in the source, from 1.
    """
    from mathquarry.functions.ids import parse_paragraph_id

    good = articles.filter("error is null").withColumn("id", article_id(F.col("identifiers")))
    ids = good.select("path", F.col("id").alias("document"))
    pars = paragraphs(good).join(ids, "path").select("document", "paragraph_id", "text")
    kind = parse_paragraph_id(F.lower("paragraph_id"))
    is_theorem = F.lower("paragraph_id").contains("thm")
    return {
        "document": good.select("id", "title", F.substring(F.try_element_at("zb_msc_cats", F.lit(1)), 1, 2).alias("main_msc_cat"), "publication_date"),
        "formula": formulas(good).join(ids, "path").select("document", "formula_id", "latex", "p_math_ml", "c_math_ml"),
        "paragraph2": pars.filter(~is_theorem),
        "theorem": pars.filter(is_theorem).select("document", "paragraph_id", kind["theorem_type"].alias("theorem_type"), "text"),
        "authorship": good.select(F.col("id").alias("document"), F.posexplode("authors").alias("p", "a")).select("document", (F.col("p") + 1).alias("rank"), F.col("a.name").alias("display_name"), F.col("a.ident").alias("zbmath_id")),
        "msc_assignment": good.select(F.col("id").alias("document"), F.posexplode(F.array_distinct("zb_msc_cats")).alias("p", "msc")).select("document", "msc", (F.col("p") + 1).alias("pos")),
    }


def full_text_tokens(articles: DataFrame) -> DataFrame:
    """(path, tokens): words of the text and LaTeX tokens of the formulas, in order."""
    from mathquarry.functions.text import latex_tokens, word_tokens

    per = F.transform("content", lambda c: F.when(c["kind"] == "text", word_tokens(c["text"])).when(c["kind"] == "formula", latex_tokens(c["latex"])).otherwise(F.array().cast("array<string>")))
    return articles.filter("error is null").select("path", F.flatten(per).alias("tokens"))


def structured_paragraphs(articles: DataFrame) -> DataFrame:
    """(path, paragraph_id, sentences): each paragraph as sentences of tokens, references kept."""
    from mathquarry.functions.text import sentence_tokens

    return paragraphs(articles).select("path", "paragraph_id", sentence_tokens(F.col("text")).alias("sentences"))
