"""Problem 4: references to records that do not exist, by bitmaps.

Keys are dictionary-encoded as integers, one range of integers for each
hash bucket of keys, so that encoding takes one shuffle and no count of all
keys on one machine.  For every range of 32,768 keys there is one compressed
bitmap of the keys cited in each period, one of the keys that live, one of the
keys withdrawn and one of the keys first loaded in each period.  The states are
set operations on them:

    missing   cited AND NOT live AND NOT withdrawn
    deleted   cited AND NOT live AND withdrawn
    late?     cited AND live AND NOT loaded in an earlier period

The surviving bits are decoded to keys and joined to the citing records; for
``late?`` the two times are then compared exactly.  References of one key and
period are one bit before any shuffle by key, so a key that a third of all rows
cite is no heavier than another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mathquarry.session import materialize

RANGE = 32768
LIVE, WITHDRAWN, LOADED, CITED = 0, 1, 2, 3


def compress(bits: np.ndarray) -> bytes:
    """A bitmap of one range from its sorted positions: the positions while they are few, else the packed bits."""
    if len(bits) * 2 <= RANGE // 16:
        return b"a" + bits.astype("<u2").tobytes()
    dense = np.zeros(RANGE, dtype=bool)
    dense[bits] = True
    return b"z" + zlib.compress(np.packbits(dense, bitorder="little").tobytes(), 1)


def expand(blob: bytes) -> np.ndarray:
    """The range's bits as booleans."""
    if blob[:1] == b"z":
        return np.unpackbits(np.frombuffer(zlib.decompress(blob[1:]), dtype=np.uint8), bitorder="little").astype(bool)
    dense = np.zeros(RANGE, dtype=bool)
    dense[np.frombuffer(blob[1:], dtype="<u2")] = True
    return dense


def _to_bitmaps(batches):
    """Sorted rows (chunk, kind, period, bit) to one compressed bitmap for each chunk, kind and period."""
    pending: list[np.ndarray] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
        starts = np.flatnonzero(np.any(cols[1:, :3] != cols[:-1, :3], axis=1)) + 1
        out = []
        for part in np.split(cols, starts):
            k = tuple(part[0, :3].tolist())
            if k != key:
                if pending:
                    out.append((*key, compress(np.unique(np.concatenate(pending)))))
                key, pending = k, []
            pending.append(part[:, 3])
        if out:
            yield _bitmap_batch(out)
    if pending:
        yield _bitmap_batch([(*key, compress(np.unique(np.concatenate(pending))))])


def _bitmap_batch(rows):
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], names=["chunk", "kind", "period", "bits"])


def _and_not(batches):
    """Sorted bitmaps of each chunk to rows (id, period, state) of the surviving bits."""
    empty = np.zeros(RANGE, dtype=bool)
    chunk, live, gone, loaded = None, empty, empty, {}
    for b in batches:
        out: list[tuple[np.ndarray, int, str]] = []
        for c, kind, period, bits in zip(*(col.to_pylist() for col in b.columns)):
            if c != chunk:
                chunk, live, gone, loaded = c, empty, empty, {}
            dense = expand(bits)
            if kind == LIVE:
                live = dense
            elif kind == WITHDRAWN:
                gone = dense
            elif kind == LOADED:
                loaded[period] = dense
            else:
                earlier = np.logical_or.reduce([m for p, m in loaded.items() if p < period]) if any(p < period for p in loaded) else empty
                for state, hits in (("missing", dense & ~live & ~gone), ("deleted", dense & ~live & gone), ("late", dense & live & ~earlier)):
                    at = np.flatnonzero(hits)
                    if len(at):
                        out.append((at + c * RANGE, period, state))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x for x, _, _ in out]), pa.int64()), pa.array(np.concatenate([np.full(len(x), p, dtype=np.int32) for x, p, _ in out])), pa.array([s for x, _, s in out for _ in range(len(x))], pa.string())],
                names=["id", "period", "state"],
            )


def _period(c):
    return (F.year(c) * 12 + F.month(c)).cast("int")


def orphan_references(refs: DataFrame, loads: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """``refs`` with their ``state``: missing, deleted or late; the others are left out.

    refs: scope, key, first (when the citing record was first loaded) and any
    columns of the citing record; loads: scope, key, at, one row for each load of
    a record; withdrawals: scope, key, at.  ``scope`` is what the key belongs to,
    so that one call serves several tables.  A null key is no reference and no
    record.  Columns of ``refs`` are kept but for one named state.  A null time: as a load it is earlier than any other and lives only if the
    key isn't withdrawn; of a citing record it makes nothing late; as a withdrawal it
    is earlier than any load.
    Repeated rows count once.  Only ``refs``, which is read twice, should be a stored table.
    """
    refs = refs.drop("state")
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda c: F.coalesce(F.col(c).cast("timestamp_ntz"), never)
    key = ["scope", "key"]
    events = (
        loads.select(*key, F.lit(0).alias("what"), at("at").alias("at"))
        .unionByName(withdrawals.select(*key, F.lit(1).alias("what"), at("at").alias("at")))
        .filter("key is not null")
        .groupBy(*key)
        .agg(F.min(F.when(F.col("what") == 0, F.col("at"))).alias("first_load"), F.max(F.when(F.col("what") == 0, F.col("at"))).alias("last_load"), F.max(F.when(F.col("what") == 1, F.col("at"))).alias("gone"))
    )
    cited = refs.filter("key is not null").select(*key, _period(at("first")).alias("period")).distinct()
    both = events.select(*key, "first_load", "last_load", "gone", F.lit(None).cast("int").alias("period")).unionByName(cited, allowMissingColumns=True)
    # The dictionary: dense numbers within each hash bucket of keys.
    buckets = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    number = F.dense_rank().over(W.partitionBy("bucket").orderBy(*key)).cast("long") - 1
    coded = materialize(both.withColumn("id", F.col("bucket") * F.lit(1 << 40) + number).drop("bucket"), "dictionary")

    def bits(rows: DataFrame, kind: int, period) -> DataFrame:
        return rows.select(F.shiftright("id", 15).alias("chunk"), F.lit(kind).alias("kind"), period.cast("int").alias("period"), F.col("id").bitwiseAND(RANGE - 1).cast("int").alias("bit"))

    known = coded.filter("period is null")
    alive = known.filter("last_load is not null and (gone is null or last_load > gone)")
    sets = (
        bits(alive, LIVE, F.lit(0))
        .unionByName(bits(known.filter("gone is not null"), WITHDRAWN, F.lit(0)))
        .unionByName(bits(alive, LOADED, _period(F.col("first_load"))))
        .unionByName(bits(coded.filter("period is not null"), CITED, F.col("period")))
    )
    order = ["chunk", "kind", "period", "bit"]
    maps = sets.repartition("chunk").sortWithinPartitions(*order).mapInArrow(_to_bitmaps, "chunk long, kind int, period int, bits binary")
    survivors = maps.mapInArrow(_and_not, "id long, period int, state string")
    # decoding: back to keys, then to the records that cite them in that period
    names = coded.filter("period is not null").select("id", "period", *key)
    firsts = known.select(F.col("id"), "first_load")
    found = survivors.join(names, ["id", "period"]).join(firsts, "id", "left").select(*key, F.col("period").alias("_period"), "state", F.col("first_load").alias("_first_load"))
    joined = refs.withColumn("_period", _period(at("first"))).join(found, [*key, "_period"])
    late = F.col("_first_load") > at("first")
    return joined.filter((F.col("state") != "late") | (late & F.col("first").isNotNull())).drop("_period", "_first_load")


# ---------------------------------------------------------------- this project's references

#: What a reference to a formula looks like in a text: any letter case, tags or their escaped form.
FORMULA_REF = r"(?i)(?:<|&lt;)fid\b([^<>&]*(?:&(?:quot|apos|nbsp|#[0-9]+);[^<>&]*)*)(?:>|&gt;)"
BLANKS = r"\s\x{a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
MARKS = r"\"'/=`\x{2018}-\x{201f}"


def formula_references(text) -> F.Column:
    """Array of the ids cited by ``<fid ...>`` references in whatever notation; empty references are left out."""
    inner = F.regexp_extract_all(text, F.lit(FORMULA_REF), F.lit(1))
    bare = F.transform(inner, lambda x: F.regexp_replace(x, f"&[a-z0-9#]+;|[{BLANKS}{MARKS}]", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def article_key(raw) -> F.Column:
    """The bare article id in lower case: without blanks, prefix and version."""
    bare = F.lower(F.regexp_replace(raw, f"[{BLANKS}]", ""))
    return F.regexp_replace(F.regexp_replace(bare, "^(?:arxiv:)+", ""), "v[0-9]+$", "")


def article_references(paragraph2: DataFrame, theorem: DataFrame, formula: DataFrame, document: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(table_name, document, paragraph_id, ref_key, state, first) of the references without a live or timely target."""
    record = ["document", "paragraph_id"]
    # Times are compared as stored, without a zone.
    formulas = paragraph2.filter(F.lower("text").contains("fid")).select(*record, F.col("loaded_at").alias("first"), F.explode(formula_references(F.col("text"))).alias("ref_key"))
    formulas = formulas.groupBy(*record, "ref_key").agg(F.min("first").alias("first")).select(F.lit("paragraph2").alias("table_name"), *record, "ref_key", "first", F.col("document").alias("scope"), F.col("ref_key").alias("key"))
    articles = theorem.filter("document is not null").groupBy(*record).agg(F.min("loaded_at").alias("first"))
    articles = articles.withColumn("ref_key", article_key(F.col("document"))).filter("ref_key <> ''")
    articles = articles.select(F.lit("theorem").alias("table_name"), *record, "ref_key", "first", F.lit("").alias("scope"), F.col("ref_key").alias("key"))
    # Scopes of formulas are article ids as stored behind a mark, so no article equals the scope of articles.
    mark = lambda c: F.concat(F.lit("f|"), c)
    refs = materialize(formulas.withColumn("scope", mark(F.col("scope"))).filter("document is not null").unionByName(articles), "references")
    loads = formula.select(mark(F.col("document")).alias("scope"), F.col("formula_id").alias("key"), F.col("loaded_at").alias("at")).unionByName(
        document.select(F.lit("").alias("scope"), F.lower("id").alias("key"), F.col("loaded_at").alias("at"))
    )
    gone = withdrawn.filter("table_name = 'formula'").select(mark(F.col("document")).alias("scope"), F.col("formula_id").alias("key"), F.col("withdrawn_at").alias("at")).unionByName(
        withdrawn.filter("table_name = 'document'").select(F.lit("").alias("scope"), F.lower("document").alias("key"), F.col("withdrawn_at").alias("at"))
    )
    return orphan_references(refs, loads.filter("scope is not null"), gone.filter("scope is not null")).select("table_name", *record, "ref_key", "state", "first")
