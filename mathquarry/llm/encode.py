"""Problem 6: encoding of a corpus by content-defined chunk reuse.

A rolling hash over the characters cuts every text into chunks at places that
depend on the content only, so texts that share a passage share its chunks.
The hashes of all chunks are counted over the corpus, exactly and at any size;
a text none of whose chunks occurs twice is encoded as a whole.  In the others a
chunk that occurs more than once is encoded once; the rest are encoded where
they are read.  A chunk's inner part, between the first and the last place where
a token must begin whatever stands around it, is final.  The joins - the rest
of one chunk and the beginning of the next - are repaired by encoding them
together, reaching over further chunks until such a place is met on both sides.
The result is that of encoding each text as a whole.

The texts are read twice, once for the hashes and once for the encoding.  What
goes from the first to the second are the texts that share something, by a digest
of the text, with the hashes they share; a table, joined as its size allows.

Null and empty texts have an empty list of ids.  Equal doc_ids stay separate
rows.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.tokenizer import DEFAULT_DIR, DEFAULT_NAME, clean, encoder, safe_points
from mathquarry.session import materialize

WINDOW = 32
CHUNK_BITS = 10  # a cut in 1,024 places on average
MIN_CHUNK = 256


def cut_positions(texts: list[str], bits: int = CHUNK_BITS, least: int = MIN_CHUNK) -> list[list[int]]:
    """For each text the ends of its chunks, the text's length being the last.

    The hash of a place covers the WINDOW characters before it; texts are
    joined for speed, and a place whose window would reach over a text's
    beginning is no cut.
    """
    out: list[list[int]] = [[len(t)] for t in texts]
    long = [i for i, t in enumerate(texts) if len(t) > least]
    if not long:
        return out
    h = np.frombuffer("".join(texts[i] for i in long).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    factor, width = 0x85EBCA6B, 1
    while width < WINDOW:
        nxt = h.copy()
        nxt[width:] += h[:-width] * np.uint32(factor)
        h, factor, width = nxt, factor * factor & 0xFFFFFFFF, width * 2
    hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends = np.cumsum([len(texts[i]) for i in long])
    begin = 0
    for i, end in zip(long, ends.tolist()):
        lo, hi = np.searchsorted(hits, [begin + max(WINDOW, least), end])
        cuts, last = [], 0
        for p in hits[lo:hi].tolist():
            if p - begin - last >= least:
                last = p - begin
                cuts.append(last)
        cuts.append(end - begin)
        out[i] = cuts
        begin = end
    return out


def chunk_hash(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8"))


def _half(h: bytes) -> int:
    """Half of a chunk's hash, by which chunks are counted; two chunks with one half only seem shared, which changes no result."""
    return int.from_bytes(h[:8], "little", signed=True)


def encode_parts(chunk: str, enc) -> tuple[str, list[int] | None, str]:
    """(beginning, ids of the inner part, rest); without a safe place all is beginning and the ids are None."""
    first, last = safe_points(chunk)
    if first < 0:
        return chunk, None, ""
    return chunk[:first], enc.encode_ordinary(chunk[first:last]), chunk[last:]


def join_parts(parts, enc) -> list[int]:
    """Ids of a text from its chunks' parts in order: joins are encoded together."""
    ids: list[int] = []
    pending: list[str] = []
    for head, mid, tail in parts:
        pending.append(head)
        if mid is not None:
            ids += enc.encode_ordinary("".join(pending))
            ids += mid
            pending = [tail]
    ids += enc.encode_ordinary("".join(pending))
    return ids


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [clean(t) if t else "" for t in batch.column(column).to_pylist()]


def _hash_rows(batches):
    for b in batches:
        keys, halves, counts = [], [], []
        texts = _texts(b, "text")
        for key, text, cuts in zip(b.column("key").to_pylist(), texts, cut_positions(texts)):
            found: dict[int, int] = {}
            last = 0
            for c in cuts:
                if c > last:
                    half = _half(chunk_hash(text[last:c]))
                    found[half] = found.get(half, 0) + 1
                last = c
            keys += [key] * len(found)
            halves += found
            counts += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(halves, pa.int64()), pa.array(counts, pa.int64())], names=["key", "half", "n"])


def sharing(docs: DataFrame) -> DataFrame:
    """(key, shared): the texts of ``docs`` (key, text) with a chunk that occurs at least twice in the corpus, and the halves of those chunks' hashes.

    A stored table; an array is no longer than its text has chunks.
    """
    hashes = materialize(docs.filter("text <> ''").select("key", "text").mapInArrow(_hash_rows, "key binary, half long, n long"), "hashes")
    twice = hashes.groupBy("half").agg(F.sum("n").alias("n")).filter("n > 1").select("half")
    return materialize(hashes.join(twice, "half", "left_semi").groupBy("key").agg(F.collect_set("half").alias("shared")), "sharing")


PARTS = "row binary, doc_id long, seq int, h binary, text string, head string, ids binary, tail string, whole array<int>"


def _parts(name: str, folder: str):
    """A text that shares nothing to one row of all its ids, another to a row for each chunk."""
    columns = [c.split()[0] for c in PARTS.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches):
        enc = encoder(name, folder)
        for b in batches:
            texts, doc_ids, shared = _texts(b, "text"), b.column("doc_id").to_pylist(), b.column("shared").to_pylist()
            some = [i for i, s in enumerate(shared) if s]
            cuts = dict(zip(some, cut_positions([texts[i] for i in some])))
            rows: list[tuple] = []
            whole: list[np.ndarray | None] = []
            for i, (text, doc) in enumerate(zip(texts, doc_ids)):
                if i not in cuts:
                    rows.append((None, doc, None, None, None, None, None, None))
                    whole.append(np.array(enc.encode_ordinary(text), dtype=np.int32))
                    continue
                row, last, mine = xxhash.xxh3_128_digest(f"{doc}|{text}".encode()), 0, set(shared[i])
                for seq, c in enumerate(cuts[i]):
                    chunk, last = text[last:c], c
                    h = chunk_hash(chunk)
                    if _half(h) in mine:
                        rows.append((row, doc, seq, h, chunk, None, None, None))
                    else:
                        head, mid, tail = encode_parts(chunk, enc)
                        rows.append((row, doc, seq, None, None, head, _pack(mid), tail))
                    whole.append(None)
            parts = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(parts, types)), _lists(whole)], names=columns)

    return run


def _pack(ids: list[int] | None) -> bytes | None:
    return None if ids is None else np.array(ids, dtype=np.int32).tobytes()


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([0 if x is None else len(x) for x in ids], out=offsets[1:])
    there = [x for x in ids if x is not None]
    values = np.concatenate(there) if there else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([x is None for x in ids], pa.bool_()))


def _id_batches(doc_ids: list, ids: list[np.ndarray]):
    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), _lists(ids)], names=["doc_id", "ids"])


def _encode_chunks(name: str, folder: str):
    def run(batches):
        enc = encoder(name, folder)
        for b in batches:
            parts = [encode_parts(t, enc) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), pa.array([p[0] for p in parts], pa.string()), pa.array([_pack(p[1]) for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.string())],
                names=["h", "head", "ids", "tail"],
            )

    return run


def _assemble(name: str, folder: str):
    """Chunk rows sorted by row, copy and seq become one row of ids for each text."""

    def run(batches):
        enc = encoder(name, folder)
        key, parts, copies = None, [], 0

        def done():
            ids = np.array(join_parts(parts, enc), dtype=np.int32)
            return [key[1]] * copies, [ids] * copies

        for b in batches:
            docs, out = [], []
            for row, doc, seq, n, head, ids, tail in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "seq", "copies", "head", "ids", "tail"))):
                if key != (row, doc):
                    if key is not None:
                        d, i = done()
                        docs += d
                        out += i
                    key, parts, copies = (row, doc), [], n
                parts.append((head, None if ids is None else np.frombuffer(ids, dtype=np.int32).tolist(), tail))
            yield from _id_batches(docs, out)
        if key is not None:
            yield from _id_batches(*done())

    return run


def encode_corpus(docs: DataFrame, name: str = DEFAULT_NAME, folder: str = DEFAULT_DIR) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id long, text string)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    told = docs.join(sharing(docs), "key", "left").select("doc_id", "text", "shared")
    stored = materialize(told.mapInArrow(_parts(name, folder), PARTS), "parts")
    direct = stored.filter("whole is not null").select("doc_id", F.col("whole").alias("ids"))
    chunks = stored.filter("whole is null").drop("whole")
    # each shared chunk once: the partial aggregate drops copies before the shuffle
    once = chunks.filter("h is not null").groupBy("h").agg(F.first("text").alias("text"))
    encoded = once.mapInArrow(_encode_chunks(name, folder), "h binary, head string, ids binary, tail string")
    refs = chunks.filter("h is not null").groupBy("row", "doc_id", "seq", "h").agg(F.count("*").alias("copies"))
    joined = refs.join(encoded, "h").select("row", "doc_id", "seq", "copies", "head", "ids", "tail")
    own = chunks.filter("h is null").groupBy("row", "doc_id", "seq", "head", "ids", "tail").agg(F.count("*").alias("copies"))
    parts = joined.unionByName(own.select("row", "doc_id", "seq", "copies", "head", "ids", "tail"))
    sorted_parts = parts.repartition("row").sortWithinPartitions("row", "doc_id", "seq")
    return direct.unionByName(sorted_parts.mapInArrow(_assemble(name, folder), "doc_id long, ids array<int>"))


def _counts(name: str, folder: str):
    def run(batches):
        enc = encoder(name, folder)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in _texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, name: str = DEFAULT_NAME, folder: str = DEFAULT_DIR) -> DataFrame:
    """(doc_id, n_tokens) for every row; null and empty texts have 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(name, folder), "doc_id long, n_tokens long")
