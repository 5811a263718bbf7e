"""Identifiers: the grammar of paragraph ids, article ids, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of theorem types in ids, in the order in which they are tried.
THEOREM_WORDS = (
    "prop pp lemma lem le lm sublemma theorem thm teo thmspec letterthm theo theof th maintheorem te mainth thma firstthm introthm corollary cor coro co maincoro "
    "example expl exm proposition pr prop propo definition df dfn def defin defn remark uremark rem rmk re remk question problem notation claim clm acknowledgment "
    "acknowledgement acknow ack ass asn assumption asm prox conx res fact conj app note dref hyp stat classics conjecture pf algorithm alg supplement ac proof issue oz demo"
).split()

# The type each abbreviation stands for; "assuption" is spelled so in the stored data. Others stand for themselves.
THEOREM_TYPES = {
    "prop": "proposition", "pr": "proposition", "pp": "proposition", "propo": "proposition",
    "thm": "theorem", "teo": "theorem", "thmspec": "theorem", "theo": "theorem", "theof": "theorem", "th": "theorem", "letterthm": "theorem", "te": "theorem", "mainth": "theorem", "maintheorem": "theorem", "thma": "theorem", "introthm": "theorem", "firstthm": "theorem",
    "dfn": "definition", "def": "definition", "defin": "definition", "defn": "definition",
    "uremark": "remark", "rem": "remark", "rmk": "remark", "re": "remark", "remk": "remark",
    "cor": "corollary", "coro": "corollary", "co": "corollary", "maincoro": "corollary",
    "expl": "example", "exm": "example",
    "lem": "lemma", "le": "lemma", "lm": "lemma", "sublemma": "lemma",
    "ack": "acknowledgment", "acknowledgement": "acknowledgment", "acknow": "acknowledgment",
    "ass": "assuption", "asm": "assuption",
    "clm": "claim", "alg": "algorithm",
}

# The grammar of the stored paragraph ids.
THEOREM_ID = r"^(?:c\d+\.)?(?:(?:s|a|ch|c)x?\d+\.)?thm(" + "|".join(THEOREM_WORDS) + r")?(?:x|f|s|e)?(?:[a-z]x)?\d+(?:\.\d+)?(?:\.p\d+)?"

#: Type, pattern, names of its groups; in the order in which the rules are tried, the first match winning.
RULES = (
    ("top_level_paragraph", r"^p(\d+)", ("paragraph",)),
    ("section_paragraph", r"^(?:c\d+\.)?(?:s|ch|a)x?(\d+)(?:\.p(\d+))?", ("section", "paragraph")),
    ("subsection_paragraph", r"^(?:c\d+\.)?(?:s|ch|a)x?(\d+)\.(?:ss)?x?(\d+)(?:\.p(\d+))?", ("section", "subsection", "paragraph")),
    ("subsubsection_paragraph", r"^(?:c\d+\.)?(?:s|ch|a)x?(\d+)\.(?:ss)?x?(\d+)\.(?:sss)?x?(\d+)(?:\.p?(\d+))?", ("section", "subsection", "subsubsection", "paragraph")),
    ("subsubsection_paragraph_paragraph", r"^(?:c\d+\.)?(?:s|ch|a)x?(\d+)\.(?:ss)?x?(\d+)\.(?:sss)?x?(\d+)\.p?x?\d+\.p(\d+)", ("section", "subsection", "subsubsection", "paragraph")),
    ("appendix_paragraph", r"^ax?(\d+)\.p(\d+)", ("appendix", "paragraph")),
    ("itemize", r"^(?:(?:ch|a|s)\d+\.)?i(\d+)\.ix?(\d+)\.px?(\d+)", ("itemize", "item", "paragraph")),
    ("itemize", r"^i(\d+\.i\d+)\.ix?(\d+)\.px?(\d+)", ("itemize", "item", "paragraph")),
    ("id", r"^id(\d+)", ("number",)),
    ("theorem", THEOREM_ID, ("abbreviation",)),
)
PARTS = ("section", "subsection", "subsubsection", "appendix", "itemize", "item", "number", "paragraph")


def theorem_type(abbreviation) -> Column:
    """The type an abbreviation stands for; unknown ones stay, none is NULL."""
    known = F.create_map(*(F.lit(x) for pair in THEOREM_TYPES.items() for x in pair))
    return F.when(abbreviation == "", F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, abbreviation), abbreviation))


def parse_paragraph_id(ident, mode: str = "reference") -> Column:
    """struct<type, section .. paragraph, theorem_type> of a lower-cased paragraph id; type is NULL if no rule matches.

    ``reference``: the first rule whose pattern begins the id wins, so the rule for sections
    shadows later ones.  ``longest``: the rule that matches most of the id wins, the first on a tie.
    """
    if mode not in ("reference", "longest"):
        raise ValueError(mode)
    ident = F.coalesce(ident, F.lit(""))
    none = F.lit(None).cast("string")
    fields = (*PARTS, "abbreviation")
    candidates = []
    for order, (name, pattern, groups) in enumerate(RULES):
        length = F.length(F.regexp_extract(ident, f"({pattern})", 1))
        got = {g: F.regexp_extract(ident, pattern, i) for i, g in enumerate(groups, 1)}
        rank = F.when(length > 0, F.lit(1) if mode == "reference" else length).otherwise(0)
        candidates.append(F.struct(rank.alias("rank"), F.lit(-order).alias("earlier"), F.lit(name).alias("type"), *(got.get(f, none).alias(f) for f in fields)))

    def shown(best):  # bound once, so that the rules aren't evaluated again for each field
        value = lambda f: F.when(best["rank"] > 0, F.nullif(F.regexp_replace(best[f], r"\.i", ".") if f == "itemize" else best[f], F.lit(""))).alias(f)
        kind = F.when((best["rank"] > 0) & best["abbreviation"].isNotNull(), theorem_type(best["abbreviation"]))
        return F.struct(value("type"), *map(value, PARTS), kind.alias("theorem_type"))

    return F.transform(F.array(F.array_max(F.array(*candidates))), shown)[0]


def first_doi(identifiers) -> Column:
    return F.try_element_at(F.filter(identifiers, lambda x: x["source"] == "doi"), F.lit(1))["ident"]


def safe_file_name(ident) -> Column:
    return F.regexp_replace(ident, "[^0-9A-Za-z]", "")


def download_action(status) -> Column:
    """What a downloader does with a response: save it, note that there is none, wait and try again, or skip."""
    return F.when(status == 200, "save").when(status == 404, "save not found").when(status == 429, "wait and retry").otherwise("skip")
