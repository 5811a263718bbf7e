"""Problem 3: linking spellings of names by a pigeonhole segment join.

A name of the dictionary is cut into k + 1 segments, k being the edits its
length allows; a typed form within edit distance k of it holds one of them
unchanged, shifted by at most k, or two letters are swapped over the border of
its first or last one.  So the dictionary becomes an inverted index of segments,
and every typed form looks up the substrings that may be one of them.  What
meets there is verified with a banded edit distance and by the given names.  A spelling is linked to a name
only if no other name suits it as well.

Typed forms are the parts of a name that may be its family name: people put it
first or last, with or without a comma, abbreviate or shorten the given names,
leave out or misplace particles, add titles and marks, and use other letters
for the same sounds.  Names of groups are compared whole, turned round,
abbreviated or as an acronym.

Null, blank and placeholder names have no link.  Repeated names are handled
once.  Names of the dictionary that are null, empty or without letters are in
no link; one that occurs under two ids suits both equally well.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.session import materialize

DISTANCE = 2
#: Letters from which on a form may have DISTANCE edits; shorter ones may have one.
LONG = 7
#: Most rows of the segment index, of about 60 bytes, that are broadcast.
BROADCAST_SEGMENTS = 200_000
#: Parts of a segment's names in a join by shuffle.
SALTS = 8

# Letters that look like Latin ones, in the order of their alphabet.
LOOKALIKE = dict(zip("аеорсухіјѕһԁѵАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdvABEKMHOPCTYXIJSaeiknoptuxABEZHIKMNOPTYX", strict=True))
# Letters without a decomposition.
PLAIN = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
# Usual other spellings of a marked letter.
SOUNDS = {"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa", "š": "sh", "č": "ch", "ć": "ch", "ž": "zh", "ñ": "ny"}
# Words that are no part of a name.
TITLES = {"prof", "professor", "dr", "mr", "mrs", "ms", "sir", "jr", "sr", "ii", "iii", "ed", "eds", "editor", "phd", "et"}
PARTICLES = {"al", "von", "van", "der", "den", "de", "la", "le", "del", "della", "di", "da", "dos", "ter", "ten", "zu", "zum", "el"}
# Short forms of given names, by the full name.
SHORT = {
    "alexander": "alex sasha sascha xander sandy", "benjamin": "ben benny benji", "catherine": "kate cathy katie cath kathy cat", "dimitri": "dima mitya", "elizabeth": "beth liz betty lizzie eliza ella lisa",
    "francesca": "franca fran cesca", "friedrich": "fritz fred freddy", "gabriella": "ella gaby gabi", "giuseppe": "beppe peppe pino", "ingrid": "inga", "joachim": "achim jochen jo", "johannes": "hans johann jan hannes",
    "jorge": "george", "josephine": "josie jo josy", "katharina": "kathe katja katya kati kathi", "margaret": "peggy meg maggie greta marge", "michael": "mike mick micky", "mikhail": "misha", "nikolai": "kolya niko nick kolja",
    "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "theodore": "ted theo teddy", "victoria": "vicky vicki tori", "vladimir": "volodya vlad vova", "william": "bill will billy liam willy",
    "anna": "annie anya", "boris": "borya", "edda": "edi", "anthony": "tony", "edward": "ed ted eddie ned", "james": "jim jimmy", "john": "jack johnny", "thomas": "tom tommy", "peter": "pete", "andrew": "andy drew", "daniel": "dan danny", "david": "dave", "christopher": "chris", "matthew": "matt", "nicholas": "nick", "charles": "charlie chuck", "henry": "harry hank", "susan": "sue susie", "barbara": "barb", "deborah": "debbie", "rebecca": "becky", "jennifer": "jenny", "patricia": "pat patty", "aleksandr": "sasha", "sergei": "seryozha", "dmitri": "dima", "ivan": "vanya",
}
FULL: dict[str, set[str]] = {}
for _full, _short in SHORT.items():
    for _s in _short.split():
        FULL.setdefault(_s, set()).add(_full)
NO_NAME = re.compile(r"^(?:anonymous|anon|unknown|none|n n|nn|et al|na|n a|various|author)?$")


@lru_cache(1 << 14)
def fold(text: str, sounds: bool = False) -> str:
    """Latin letters in lower case without marks; look-alikes of other alphabets become Latin."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(LOOKALIKE.get(c, c) for c in text if unicodedata.category(c) != "Cf").lower()
    if sounds:
        text = "".join(SOUNDS.get(c, c) for c in text)
    text = "".join(PLAIN.get(c, c) for c in text)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def compact(tokens: list[str]) -> str:
    return "".join(re.sub("[^a-z]", "", t) for t in tokens)


def _tokens(part: str) -> list[str]:
    out = []
    for t in re.findall(r"[a-z'’\-]+\.?|[a-z]\.", part.replace(".", ". ")):
        bare = t.strip("-'’.")
        if bare and bare not in TITLES:
            out.append(bare + "." * t.endswith("."))
    return out


@lru_cache(1 << 12)
def readings(name: str | None) -> list[tuple[str, list[str]]]:
    """Ways to read a typed name as (family name, given names); the family name is bare letters.

    A given name keeps the dot of an abbreviation.
    """
    if not name:
        return []
    text = re.sub(r"\\[a-zA-Z'`^\"~=.]|[{}$]", "", re.sub(r"[~_\t\r\n\xa0]", " ", name)) if "\\" in name else re.sub(r"[~_\t\r\n\xa0]", " ", name)
    caps = {fold(m) for m in re.findall(r"(?<!\S)[A-Z]{2,3}(?![\w.])", text)} if re.search("[a-z]", text) else set()
    text = fold(text)
    text = re.sub(r"\((?:eds?|hrsg|editors?|transl?)\.?\)|[\[(]?[\d*†‡§¹²³]+[\])]?", " ", text)
    if NO_NAME.match(re.sub("[^a-z]+", " ", text).strip()):
        return []
    parts = [p for p in (_tokens(p) for p in re.split("[,;]", text)) if p]
    spread = lambda given: [x for t in given for x in (list(t) if t in caps and t not in FULL else [t])]
    out: list[tuple[str, list[str]]] = []
    if len(parts) >= 2:
        family, given = parts[0], [t for p in parts[1:] for t in p]
        out.append((compact(family), spread(given)))
        cut = len(given)
        while cut > 1 and given[cut - 1] in PARTICLES:  # Family, Given von
            cut -= 1
        if cut < len(given):
            out.append((compact(given[cut:] + family), spread(given[:cut])))
        if len(given) >= 1 and len(family) == 1:  # the comma may be misplaced
            out.append((compact(given[-1:]), spread(family + given[:-1])))
    elif parts:
        tokens = parts[0]
        for j in range(1, min(4, len(tokens)) + 1):
            out.append((compact(tokens[-j:]), spread(tokens[:-j])))
            if j < len(tokens):
                out.append((compact(tokens[:j]), spread(tokens[j:])))
                cut = len(tokens)
                while cut > j and tokens[cut - 1] in PARTICLES:
                    cut -= 1
                if cut < len(tokens):
                    out.append((compact(tokens[cut:] + tokens[:j]), spread(tokens[j:cut])))
    seen: set = set()
    return [r for r in out if len(r[0]) >= 3 and not ((k := (r[0], tuple(r[1]))) in seen or seen.add(k))]


def is_group(preferred: str) -> bool:
    """Persons are written with a comma, groups without."""
    return "," not in preferred


@lru_cache(1 << 14)
def group_forms(preferred: str) -> list[tuple[str, int]]:
    """Spellings of a group's name with their cost: whole, turned round, abbreviated."""
    words = [w for w in re.findall("[a-z]+", fold(preferred)) if w != "the"]
    forms: dict[str, int] = {}
    for kinds in (1, 2):
        if len(words) <= kinds:
            continue
        head, kind = words[:-kinds], words[-kinds:]
        for cost, h, k in [(0, head, kind), *((1, [*head[:-1], head[-1][:n]], kind) for n in (3, 4)), *((1, head, [w[:n] for w in kind]) for n in (3, 4)), *((2, [*head[:-1], head[-1][:n]], [w[:n] for w in kind]) for n in (3, 4))]:
            for order in (h + k, k + h):
                forms.setdefault("".join(order), cost)
    return list(forms.items())


@lru_cache(1 << 14)
def acronym(preferred: str) -> str:
    return "".join(w[0] for w in re.findall("[a-z]+", fold(preferred)) if w not in ("the", "of", "and", "for"))


def dictionary_forms(preferred: str | None) -> list[str]:
    """The strings under which a name of the dictionary is found."""
    if not preferred or not re.search("[a-z]", fold(preferred)):
        return []
    if is_group(preferred):
        return sorted({f for f, _ in group_forms(preferred)} | {acronym(preferred)})
    family = preferred.split(",")[0]
    return sorted({f for words in family_words(family) for f in (compact(words),) if len(f) >= 3})


def family_words(family: str) -> list[list[str]]:
    """A family name with and without its particles, and with the usual other spellings of marked letters."""
    out = []
    for sounds in (False, True):
        words = fold(family, sounds).split()
        bare = [w for w in words if w not in PARTICLES]
        out += [words, bare] if bare else [words]
    return out


def typed_forms(name: str | None) -> list[str]:
    forms = {f for f, _ in readings(name)}
    if name:
        forms.add(whole_form(name))
    return sorted(f for f in forms if len(f) >= 3)


@lru_cache(1 << 12)
def whole_form(name: str) -> str:
    return "".join(w for w in re.findall("[a-z]+", fold(name)) if w != "the")


# ---------------------------------------------------------------- segments


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 segments of a string of length n, nearly equal."""
    base, extra = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


def edits(length: int) -> int:
    """Edits that a form of so many letters may have."""
    return DISTANCE if length >= LONG else 1


def indexed(form: str) -> list[int]:
    """Keys of a dictionary form: its length, number and text of each segment."""
    return [_key(len(form), i, form[at : at + size]) for i, (at, size) in enumerate(segments(len(form), edits(len(form)))) if size]


def looked_up(form: str) -> set[int]:
    """Keys of all substrings that may be a segment of a dictionary form within the distance that its length allows."""
    out, n = set(), len(form)
    for length in range(max(1, n - DISTANCE), n + DISTANCE + 1):
        k, shift = edits(length), n - length
        if abs(shift) > k:
            continue
        parts = segments(length, k)
        for i, (at, size) in enumerate(parts):
            if not size:
                continue
            # with i edits before the segment at most, and k - i after it
            lo, hi = max(at - i, at + shift - (k - i), 0), min(at + i, at + shift + (k - i), n - size)
            for p in range(lo, hi + 1):
                out.add(_key(length, i, form[p : p + size]))
        # A swap of letters over a border spoils two segments: the first or the last one is whole but for its letter there.
        size = parts[0][1]
        if 0 < size < n:
            out.add(_key(length, 0, form[: size - 1] + form[size]))
        size = parts[-1][1]
        if 0 < size < n:
            out.add(_key(length, k, form[n - size - 1] + form[n - size + 1 :]))
    return out


def _key(length: int, i: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{length}|{i}|{text}") - (1 << 63)


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with neighbouring letters swapped as one edit, in a band of k; k + 1 if it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    before: list[int] = []
    row = [j if j <= k else k + 1 for j in range(m + 1)]
    for i in range(1, n + 1):
        last2, before, row = before, row, [k + 1] * (m + 1)
        if i <= k:
            row[0] = i
        best = row[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            x = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, last2[j - 2] + 1)
            row[j] = x if x <= k else k + 1
            best = min(best, row[j])
        if best > k:
            return k + 1
    return row[m]


# ---------------------------------------------------------------- verification


def given_cost(typed: list[str], known: list[str]) -> int | None:
    """How far typed given names are from a person's; None if they are someone else's. Steps of an edit are 10."""
    if not typed:
        return 60
    cost = 0
    t, p = typed[0], known[0]
    bare = t.rstrip(".")
    if len(bare) in (2, 3) and bare not in FULL and not p.startswith(bare):  # initials written as one
        typed = [*bare, *typed[1:]]
        t = bare = bare[0]
    if bare == p:
        pass
    elif len(bare) == 1:
        if bare != p[0]:
            return None
        cost += 3
    elif bare in FULL and p in FULL[bare]:
        cost += 1
    elif len(bare) >= 3 and p.startswith(bare) and (t.endswith(".") or len(bare) < len(p) - 1):
        cost += 2
    else:
        best = distance(bare, p, 2)
        short = min((distance(bare, s, 1) for s, full in FULL.items() if p in full and len(s) > 3), default=2)
        if best <= 1 or best == 2 and len(p) >= 7:
            cost += 10 * best
        elif short <= 1:
            cost += 11
        else:
            return None
    rest, middle = [x.rstrip(".") for x in typed[1:] if x.rstrip(".") not in PARTICLES], known[1:]
    for i, x in enumerate(rest):
        if i < len(middle):
            if x[0] != middle[i][0]:
                return None
        else:
            cost += 4
    return cost + 2 * max(0, len(middle) - len(rest))


@lru_cache(1 << 14)
def person(preferred: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Forms of the family name with their cost, and the given names."""
    family, given = preferred.split(",", 1)
    usual = fold(family).split()
    return [(compact(words), 0 if i == 0 or words == usual else 1) for i, words in enumerate(family_words(family))], re.findall("[a-z]+", fold(given))


def suits(name: str, preferred: str, k: int = DISTANCE) -> int | None:
    """Cost of reading ``name`` as a spelling of ``preferred``; None if it is none. An edit costs 10."""
    if is_group(preferred):
        whole = whole_form(name)
        costs = [c + 10 * d for f, c in group_forms(preferred) if (d := distance(whole, f, k if len(f) >= 8 else 0)) <= k]
        if whole == acronym(preferred) and len(whole) >= 3 and not re.search("[a-z]", name):
            costs.append(5)
        return min(costs, default=None)
    forms, known = person(preferred)
    if not known:
        return None
    best = None
    for typed, names in readings(name):
        g = None
        for form, extra in forms:
            most = min(k, edits(len(form)))
            d = distance(typed, form, most)
            if d <= most:
                g = given_cost(names, known) if g is None else g
                if g is None:
                    break
                cost = 10 * d + extra + g
                best = cost if best is None else min(best, cost)
    return best


#: Edits in family and given names together, and a reading without given names, that still make a spelling.
MOST = 29


def _lookup_rows(batches):
    for b in batches:
        rows = [(n, key) for n in b.column(0).to_pylist() for key in set().union(*(looked_up(f) for f in typed_forms(n)), ())]
        names, keys = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64())], names=["name", "segment"])


def _index_rows(batches):
    for b in batches:
        rows = [(i, n, key) for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for key in set().union(*(indexed(f) for f in dictionary_forms(n)), ())]
        ids, names, keys = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(keys, pa.int64())], names=["id", "preferred", "segment"])


def _verify(batches):
    """The cost of each pair that meets; most of the repeats of a pair stand near each other and are scored once."""
    for b in batches:
        pairs = list(dict.fromkeys(zip(*(b.column(c).to_pylist() for c in ("name", "id", "preferred")))))
        scored = [(n, i, c) for n, i, p in pairs if (c := suits(n, p)) is not None and c <= MOST]
        names, ids, cost = zip(*scored) if scored else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(cost, pa.int32())], names=["name", "id", "cost"])


def link_names(typed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, id, cost) for the distinct ``typed`` (name) that are spellings of exactly one name of ``dictionary`` (id, preferred)."""
    n = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions by name, so that few bytes of names aren't one task
    names = typed.select(F.col("name").cast("string")).filter("name is not null and trim(name) <> ''").repartition(n, "name").distinct()
    index = dictionary.select(F.col("id").cast("string"), F.col("preferred").cast("string")).distinct().mapInArrow(_index_rows, "id string, preferred string, segment long")
    index = materialize(index, "segments")
    probes = names.mapInArrow(_lookup_rows, "name string, segment long")
    # A small dictionary goes to the names; a large one and the names' segments meet by a shuffle, each segment in parts.
    if index.count() <= BROADCAST_SEGMENTS:
        met = probes.join(F.broadcast(index), "segment")
    else:
        salted = probes.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
        met = salted.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["segment", "salt"])
    scored = met.select("name", "id", "preferred").mapInArrow(_verify, "name string, id string, cost int")
    per = scored.groupBy("name", "id").agg(F.min("cost").alias("cost"))
    # the least cost, and how many have it, without gathering a name's candidates
    least = per.groupBy("name").agg(F.min("cost").alias("cost"))
    ties = per.join(least, ["name", "cost"]).groupBy("name", "cost").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return ties.filter("n = 1").select("name", "id", "cost")
