"""Schemas of the relational tables and of derived structures."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


IDENTIFIER = _struct(ident=S, source=S)
AUTHOR = _struct(name=S, ident=S)
FORMULA = _struct(formula_id=S, latex=S, p_math_ml=S, c_math_ml=S)
CONTENT = _struct(pos=I, kind=S, ident=S, text=S, latex=S, p_math_ml=S, c_math_ml=S)
PARAGRAPH = _struct(paragraph_id=S, text=S)
ARTICLE = _struct(
    path=S, identifiers=T.ArrayType(IDENTIFIER), title=S, abstract=S, languages=T.ArrayType(S), included_sources=T.ArrayType(S), publication_date=T.DateType(),
    zb_msc_cats=T.ArrayType(S), arxiv_cats=T.ArrayType(S), authors=T.ArrayType(AUTHOR), content=T.ArrayType(CONTENT), error=S,
)
TABLES = {
    "document": _struct(id=S, title=S, main_msc_cat=S, publication_date=T.DateType()),
    "formula": _struct(document=S, formula_id=S, latex=S, p_math_ml=S, c_math_ml=S),
    "paragraph": _struct(document=S, paragraph_id=S, sentences=T.ArrayType(T.ArrayType(S))),
    "paragraph2": _struct(document=S, paragraph_id=S, text=S),
    "theorem": _struct(document=S, paragraph_id=S, theorem_type=S, text=S),
    "authorship": _struct(document=S, rank=I, display_name=S, zbmath_id=S),
    "msc_assignment": _struct(document=S, msc=S, pos=I),
}
COO = _struct(row_id=L, col=I, value=D)
VOCAB = _struct(token=S, idx=I)
ARFF = _struct(id=S, classes=T.ArrayType(S), data=T.MapType(I, D), storage=S)
CLUSTERS = _struct(doc_id=S, cluster=I)
CHI = _struct(**{"class": S, "idx": I, "score": D, "p": D})
