"""Problem 5: near-duplicate records by rare-first prefix filtering.

Records become sets of words; equal sets are one class.  The words of a set are
ordered rare first, by a table of word frequencies hashed to a fixed number of
cells (any total order gives exact results; a good one gives few candidates).
Two sets whose Jaccard similarity is at least ``t`` share at least

    need(a, b) = ceil(t / (1 + t) * (a + b))

words, a and b being their sizes.  So they share one among the first
``size - need + 1`` words of each, and n among the first ``size - need + n``.
Sets are joined on single words of these prefixes while a word is in at most
``hot`` sets, on n-grams of prefix words where it is in more; ``hot`` grows with
the square root of the number of records, so that the pairs that meet in one word
grow no faster than the records.  Each joined pair
passes the length filter, the positional filter (what the words after the
shared one can still give) and the suffix filter (a set's signature has 64 bits,
each the parity of the words in one of 64 parts; every part in which two sets
differ in parity has a word in which they differ).  Each pair is then
verified once on its words.

Null, empty and word-less texts are in no class; a record without a key is in a class but in
no pair; repeated records count once.

The result of ``similar_classes`` has one row per pair of classes; copies are
in ``members`` and are expanded to record pairs only where a result asks for it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.words import words
from mathquarry.session import materialize

#: Cells of the frequency table: its size, 4 MiB, is fixed.
CELLS = 1 << 20
#: Sets with a word from which on it is joined as part of n-grams: so many times the root of the number of records.
HOT = 7.0
#: Cells in one row of the frequency table on its way to the driver.
BUCKET = 1 << 12
THRESHOLD = (4, 5)


def hash_set(field: str, text: str | None) -> list[int]:
    """Hashes of the words of a text, other ones in another field; null is a field of its own."""
    seed = xxhash.xxh32_intdigest("\0" if field is None else field)
    return [xxhash.xxh3_64_intdigest(w, seed) for w in set(words(text))]


def _frequencies(batches):
    total = np.zeros(CELLS, dtype=np.int64)
    for b in batches:
        cells = [h % CELLS for field, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in hash_set(field, t)]
        total += np.bincount(np.array(cells, dtype=np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])


def _buckets(batches):
    """(bucket, counts): BUCKET cells in one row; the cells of a bucket are in one task."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        cells, n = b.column("cell").to_numpy(), b.column("n").to_numpy()
        for k in np.unique(cells // BUCKET).tolist():
            mine = cells // BUCKET == k
            found.setdefault(k, np.zeros(BUCKET, dtype=np.int32))[cells[mine] % BUCKET] = n[mine]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["bucket", "counts"])


def frequency_table(records: DataFrame) -> np.ndarray:
    """Records of each cell, capped at the largest int32; CELLS / BUCKET rows reach the driver, 4 MiB whatever the records are."""
    rows = records.select("field", "text").mapInArrow(_frequencies, "cell int, n long").groupBy("cell").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    table = np.zeros(CELLS, dtype=np.int32)
    for r in rows.repartition(16, F.floor(F.col("cell") / BUCKET)).mapInArrow(_buckets, "bucket int, counts binary").collect():
        table[r["bucket"] * BUCKET : (r["bucket"] + 1) * BUCKET] = np.frombuffer(r["counts"], dtype=np.int32)
    return table


def _sets(cells):
    """(field, key, text) to (field, key, set id, words rare first, how many of them are rare, signature)."""

    def run(batches):
        freq, hot = cells.value
        seen: set = set()
        for b in batches:
            sets = [hash_set(field, text) for field, text in zip(b.column("field").to_pylist(), b.column("text").to_pylist())]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            there = np.flatnonzero(sizes)
            if not len(there):
                continue
            n = sizes[there]
            h = np.array([x for s in sets for x in s], dtype=np.uint64)
            row = np.repeat(np.arange(len(there)), n)
            f = freq[(h % np.uint64(CELLS)).astype(np.int64)]
            order = np.lexsort((h, f, row))
            h, f = h[order], f[order]
            offsets = np.concatenate([[0], np.cumsum(n)])
            starts = offsets[:-1]
            lone, cold = np.add.reduceat((f < 2).astype(np.int32), starts), np.add.reduceat((f <= hot).astype(np.int32), starts)
            parity = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(40)) % np.uint64(64), starts).view(np.int64)
            raw = h.tobytes()
            rids = [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = np.frombuffer(b"".join(rids), dtype=np.int64)[::2]
            fresh = [not (r in seen or seen.add(r)) for r in rids]
            if len(seen) > 500_000:
                seen.clear()
            words_ = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))
            pick = pa.array(there)
            yield pa.RecordBatch.from_arrays(
                [b.column("field").take(pick), b.column("key").take(pick), pa.array(rids, pa.binary()), pa.array(ids), pa.array(n.astype(np.int32)), words_, pa.array(lone.astype(np.int32)), pa.array(cold.astype(np.int32)), pa.array(parity), pa.array(fresh)],
                names=["field", "key", "rid", "id", "size", "words", "lone", "cold", "sig", "fresh"],
            )

    return run


def word_sets(records: DataFrame) -> DataFrame:
    """Stored table of the sets of ``records`` (field, key, text); ``fresh`` marks one row at least of each set."""
    hot = max(1, int(HOT * math.sqrt(records.count())))
    cells = records.sparkSession.sparkContext.broadcast((frequency_table(records), hot))
    schema = "field string, key string, rid binary, id long, size int, words array<long>, lone int, cold int, sig long, fresh boolean"
    return materialize(records.select("field", "key", "text").mapInArrow(_sets(cells), schema), "sets")


def _ceil(num, by: int):
    return F.floor((num + (by - 1)) / by)


def _prefix(side: str, t) -> F.Column:
    """Length of the 1-prefix: of an indexed set for partners at least as large, of a probing one for all partners not larger."""
    size = F.col("size").cast("long")
    share = _ceil(size * (2 * t[0]), t[0] + t[1]) if side == "index" else _ceil(size * t[0], t[1])
    return (size - share + 1).cast("int")


def _keys(sets: DataFrame, side: str, t) -> DataFrame:
    """A row for each prefix word or n-gram of prefix words: gram, ``pos`` and what the filters need.

    A pair is met under its first shared word, or its first two.  ``pos`` is such
    that the words from there on, and no earlier ones, can be shared: the word's
    position, or one less than that of the second word.
    """
    base = ["id", "size", "sig"]
    prefixed = sets.withColumn("prefix", _prefix(side, t))
    # Words of one record only are in no pair; hot words go in n-grams.
    single = prefixed.filter("lone < prefix and lone < cold").select(*base, "lone", "cold", F.posexplode(F.slice("words", F.lit(1), F.col("prefix"))).alias("pos", "gram"))
    single = single.filter("pos >= lone and pos < cold").select(*base, "gram", "pos")
    firsts = F.posexplode(F.slice("words", F.col("cold") + 1, F.col("prefix") - F.col("cold"))).alias("i", "w")
    hot = prefixed.filter("cold < prefix").select(*base, "words", "prefix", "cold", firsts).withColumn("i", F.col("i") + F.col("cold"))
    seconds = F.slice("words", F.col("i") + 2, F.greatest(F.least(F.col("prefix") + 1, F.col("size")) - F.col("i") - 1, F.lit(0)))
    pairs = hot.select(*base, "i", "w", F.posexplode(seconds).alias("j", "v")).select(*base, F.xxhash64("w", "v").alias("gram"), (F.col("i") + F.col("j")).alias("pos"))
    return single.unionByName(pairs)


#: Sizes within this factor are one band.
BAND = 1.16


def _band(size) -> F.Column:
    return F.floor(F.log(size.cast("double")) / math.log(BAND)).cast("int")


def candidates(sets: DataFrame, t=THRESHOLD) -> DataFrame:
    """(a, b) pairs of sets, by the first half of their ids, that passed the filters, each once; a is the larger set.

    A gram is joined within the larger set's band of sizes, so that most pairs that
    the length and positional filters would drop never meet: an indexed row goes to the
    bands of the sizes that both filters allow it as partners, a probing one to its own.
    """
    if 2 * t[0] <= t[1]:
        raise ValueError("the threshold must exceed 1/2")  # else different sets may share one word only
    fresh = sets.filter("fresh")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, pos = F.col("size").cast("long"), F.col("pos")
    most = F.least(F.floor(size * t[1] / t[0]), F.floor((size - pos) * (t[0] + t[1]) / t[0]) - size)
    index = _keys(fresh, "index", t).withColumn("most", most).filter(F.col("most") >= size).withColumn("band", F.explode(F.sequence(_band(size), _band(F.col("most")))))
    probe = _keys(fresh, "probe", t).withColumn("band", _band(size))
    # The copies of a set that several tasks marked as fresh meet under their gram and become one row.
    row = ["id", F.shiftleft(size, 32).bitwiseOR(pos.cast("long")).alias("at"), "sig", F.xxhash64("gram", "band").alias("gram")]
    side = lambda keys: keys.select(*row).repartition(n, "gram").distinct()
    unpack = lambda d, one, m, i, sig: d.select("gram", F.col("id").alias(one), F.shiftright("at", 32).alias(m), F.col("at").bitwiseAND(0x7FFFFFFF).alias(i), F.col("sig").alias(sig))
    x, y = unpack(side(probe), "a", "m", "i", "sa"), unpack(side(index), "b", "k", "j", "sb")
    both = F.col("m") + F.col("k")
    # In integers: (t0 + t1) * shared >= t0 * (m + k).
    scale, want = t[0] + t[1], both * t[0]
    length = F.col("k") * t[1] >= F.col("m") * t[0]
    larger = (F.col("m") > F.col("k")) | ((F.col("m") == F.col("k")) & (F.col("a") > F.col("b")))
    positional = F.least(F.col("m") - F.col("i"), F.col("k") - F.col("j")) * scale >= want
    differ = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    suffix = (both - differ) * scale >= want * 2
    pairs = x.join(y, "gram").filter(length & positional & suffix & larger)
    return pairs.select("a", "b").distinct()


def similar_classes(sets: DataFrame, t=THRESHOLD) -> DataFrame:
    """(a, b, shared, jaccard) for every pair of different sets with a Jaccard similarity of at least ``t``."""
    found = materialize(candidates(sets, t), "candidates")
    ids = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    wanted = maybe(sets.filter("fresh").select("id", "rid", "words"), ids).join(ids, "id", "left_semi").dropDuplicates(["rid"])
    side = lambda x: wanted.select(F.col("id").alias(x), F.col("rid").alias(f"r{x}"), F.col("words").alias(f"w{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("wa", "wb")).cast("long")
    either = F.size("wa") + F.size("wb") - F.col("shared")
    verified = both.select("ra", "rb", shared.alias("shared"), "wa", "wb").filter(F.col("shared") * t[1] >= either * t[0])
    return verified.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "shared", (F.col("shared") / either).alias("jaccard"))


FILTER_BITS = 1 << 23


def maybe(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id may be among ``ids``, by a bitmap of fixed size; keeps rows from moving that nothing needs."""
    bit = F.pmod("id", F.lit(FILTER_BITS)) + 1
    maps = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps.collect():  # at most FILTER_BITS / 32768 rows of 4 KiB
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def hit(p):
        import pandas as pd

        v = p.to_numpy()
        return pd.Series((shipped.value[v >> 3] >> (v & 7) & 1).astype(bool))

    return rows.withColumn("bit", F.pmod("id", F.lit(FILTER_BITS))).filter(hit("bit")).drop("bit")


def members(sets: DataFrame) -> DataFrame:
    """(field, rid, key): the records of each class."""
    return sets.select("field", "rid", "key").distinct()


def record_pairs(sets: DataFrame, t=THRESHOLD) -> DataFrame:
    """(field, key_a, key_b): all pairs of records with different keys and similar sets, key_a < key_b by bytes."""
    who = materialize(members(sets), "members")
    pairs = similar_classes(sets, t).select("a", "b")
    many = who.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    links = pairs.unionByName(many)
    left = links.join(who.select(F.col("rid").alias("a"), "field", F.col("key").alias("p")), "a")
    # within a class only the pairs in one order meet
    right = who.select(F.col("rid").alias("r"), F.col("key").alias("q"))
    both = left.join(right, (F.col("b") == F.col("r")) & ((F.col("p") < F.col("q")) | ((F.col("a") != F.col("b")) & (F.col("p") != F.col("q")))))
    return both.select("field", F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b")).distinct()


def groups(sets: DataFrame, t=THRESHOLD) -> DataFrame:
    """One row per record: (field, key, class_id, group_id, n_links).

    Records of one class have equal sets; a group joins classes that are similar
    directly or over others; ``n_links`` counts the other records a record is similar to.
    """
    who = materialize(members(sets), "members")
    sizes = who.groupBy("rid").agg(F.count("*").alias("n"))
    pairs = materialize(similar_classes(sets, t).select("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("rid").alias("b"), "n"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("linked"))
    group = components(pairs)
    rows = who.join(sizes, "rid").join(links, "rid", "left").join(group, "rid", "left")
    return rows.select(
        "field", "key", F.lower(F.hex("rid")).alias("class_id"), F.lower(F.hex(F.coalesce("group", "rid"))).alias("group_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )


def components(edges: DataFrame) -> DataFrame:
    """(rid, group): the smallest id of each node's connected component, by alternating large and small stars.

    Every round is a join and an aggregate over the edges and is stored; there are
    about as many rounds as the logarithm of the longest path.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "stars")
        said = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if said == mark:
            break
        mark = said
    ends = now.groupBy("u").agg(F.min("v").alias("group"))
    return ends.select(F.col("u").alias("rid"), "group").unionByName(now.select(F.col("v").alias("rid"), F.col("v").alias("group")).distinct())
