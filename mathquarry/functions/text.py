"""Text and LaTeX tokenizers and string functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of two or more word characters of any script.
WORD = r"[\p{L}\p{N}_]{2,}"
REFERENCE = "<fid ([^>]+)>"
LATEX = r"(?s)\\[A-Za-z]+|\\.|[A-Za-z0-9+\-*/_|\[\]()!<>=^]"

# The stop list of review texts, as given.
REVIEW_STOP_WORDS = (
    "the of and in is to for with that are on we it this by an be a problem model method result which "
    "paper par solution author can some if such also at using or show these where then given zbl"
).split()

# Mathematicians whose names are looked for among text tokens, as given.
MATHEMATICIANS = (
    "fibonacci kepler fermat pascal bernoulli leibniz newton euler lagrange monge laplace legendre fourier gauss cauchy abel jacobi dirichlet galois weierstrass "
    "cayley hermite kronecker riemann dedekind cantor klein hilbert minkowski hausdorff lebesgue weyl ramanujan banach neumann weil turing serre grothendieck perelman"
).split()


# ---------------------------------------------------------------- lemmas and stems


def identity(tokens: Column) -> Column:
    return tokens


def noun_lemmatizer(lexicon: set[str] | None = None) -> Callable[[Column], Column]:
    """Takes plural endings off nouns; with a lexicon only where that gives a known word.

    The lexicon of the usual English lemmatiser isn't available here, so without one
    only regular endings of words of four letters or more are taken off.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def lemmas(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [singular(t, lexicon) for t in ts])

    return lemmas


#: Noun endings and what takes their place.
ENDINGS = (("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", ""))


def singular(word: str, lexicon: set[str] | None = None) -> str:
    if lexicon is not None:
        if word in lexicon:
            return word
        found = [word[: -len(e)] + r for e, r in ENDINGS if word.endswith(e)]
        known = [w for w in found if w in lexicon]
        return min(known, key=len) if known else word
    if len(word) < 4 or word.endswith(("ss", "us", "is")):
        return word
    for e, r in (("ies", "y"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("sses", "ss"), ("s", "")):
        if word.endswith(e):
            return word[: -len(e)] + r
    return word


def word_tokens(text, prefix: str = "", lemmatize: Callable[[Column], Column] = identity, stop: list[str] | None = None) -> Column:
    """Lower-cased words in order; a stop list applies after lemmatising. Null text has no tokens."""
    tokens = lemmatize(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower))
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    return F.transform(tokens, lambda t: F.concat(F.lit(prefix), t)) if prefix else tokens


def latex_tokens(latex) -> Column:
    """``\\cmd`` becomes ``$cmd$``, an escaped sign and every letter, digit or operator ``$x$``; the rest is dropped."""
    raw = F.regexp_extract_all(F.coalesce(latex, F.lit("")), F.lit(LATEX), F.lit(0))
    bare = F.transform(raw, lambda t: F.when((F.length(t) > 1) & t.startswith("\\"), F.substr(t, F.lit(2))).otherwise(t))
    return F.transform(bare, lambda t: F.concat(F.lit("$"), t, F.lit("$")))


def whole_formula_token(latex) -> Column:
    """A formula as one bare token of its letters and digits."""
    return F.regexp_replace(latex, "[^0-9A-Za-z]", "")


# ---------------------------------------------------------------- mixed texts


def mixed_parts(text) -> Column:
    """array<struct<part_pos, kind, value>>: passages and formula ids in turn, beginning and ending with a passage."""
    passages = F.split(F.coalesce(text, F.lit("")), REFERENCE)
    ids = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(1))
    part = lambda pos, kind, v: F.struct(pos.cast("int").alias("part_pos"), F.lit(kind).alias("kind"), v.alias("value"))
    both = F.concat(F.transform(passages, lambda v, i: part(i * 2, "text", v)), F.transform(ids, lambda v, i: part(i * 2 + 1, "formula", v)))
    return F.array_sort(both)


def sentences(text) -> Column:
    """Sentences of an English text: cut after . ! or ? that blanks and a capital, digit or reference follow."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}<$(\\\[])", "\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def sentence_parts(sentence, keep_references: bool = True) -> Column:
    """Tokens of a sentence: words, and references as ``<fid ID>`` unless they are left out."""
    tokens = lambda p: F.when(p["kind"] == "text", word_tokens(p["value"])).otherwise(F.array(F.concat(F.lit("<fid "), p["value"], F.lit(">"))))
    parts = mixed_parts(sentence)
    if not keep_references:
        parts = F.filter(parts, lambda p: p["kind"] == "text")
    return F.flatten(F.transform(parts, tokens))


def sentence_tokens(text) -> Column:
    """array<array<string>>: the sentences of a paragraph as tokens."""
    return F.transform(sentences(text), lambda s: sentence_parts(s))


def inline_formulas(tokens, latex_by_id) -> Column:
    """References in a token list become ``$latex$`` by a map id -> latex; unknown ones are left out."""
    fid = lambda t: F.regexp_extract(t, "^<fid (.+)>$", 1)
    done = F.transform(tokens, lambda t: F.when(t.startswith("<fid "), F.concat(F.lit("$"), F.try_element_at(latex_by_id, fid(t)), F.lit("$"))).otherwise(t))
    return F.filter(done, lambda t: t.isNotNull())


def dollar_parts(text) -> Column:
    """array<struct<part_pos, kind, value>> of a text whose formulas stand between dollar signs."""
    text = F.coalesce(text, F.lit(""))
    passages, inner = F.split(text, r"\$[^$]*\$"), F.regexp_extract_all(text, F.lit(r"\$([^$]*)\$"), F.lit(1))
    part = lambda pos, kind, v: F.struct(pos.cast("int").alias("part_pos"), F.lit(kind).alias("kind"), v.alias("value"))
    return F.array_sort(F.concat(F.transform(passages, lambda v, i: part(i * 2, "text", v)), F.transform(inner, lambda v, i: part(i * 2 + 1, "formula", v))))


def dollar_tokens(text, stop: list[str] | None = None) -> Column:
    """Words of the passages and one bare token for each formula, in order."""
    token = lambda p: F.when(p["kind"] == "text", word_tokens(p["value"], stop=stop)).otherwise(F.filter(F.array(whole_formula_token(p["value"])), lambda t: t != ""))
    return F.flatten(F.transform(dollar_parts(text), token))


# ---------------------------------------------------------------- characters


def ascii_escape_text(text: str | None) -> str | None:
    """Other than ASCII characters become ``&#N;``; then what isn't printable goes."""
    if text is None:
        return None
    return "".join(c for c in text.encode("ascii", "xmlcharrefreplace").decode() if " " <= c <= "~" or c in "\t\n\r\x0b\x0c")


@F.pandas_udf(T.StringType())
def ascii_escape(text: pd.Series) -> pd.Series:
    return text.map(ascii_escape_text)


def printable(text) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def alphanumeric(text) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


# ---------------------------------------------------------------- token lists


def formula_tokens(tokens) -> Column:
    """The ``$...$`` tokens of a list."""
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & t.startswith("$") & t.endswith("$"))


def dump_paragraph(sentences_) -> Column:
    """Sentences of tokens as text again: blanks between tokens, a full stop and a blank between sentences."""
    return F.array_join(F.transform(sentences_, lambda s: F.array_join(s, " ")), ". ")


def is_reference(token) -> Column:
    return token.startswith("<fid ")


def porter(word: str) -> str:
    """The suffix-stripping algorithm published in 1980."""
    if len(word) <= 2:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))
    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))

    def measure(w: str) -> int:
        shape = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
        return sum(1 for a, b in zip(shape, shape[1:]) if a + b == "vc")

    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"

    def replaced(w: str, rules, least: int) -> str:
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if measure(stem) > least else w
        return w

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # The published endings of steps 2 to 4.
    w = replaced(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = replaced(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_stems(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(t):
        if t not in known:
            known[t] = porter(t)
        return known[t]

    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])
