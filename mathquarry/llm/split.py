"""Problem 8: cutting oversized texts at natural boundaries by pointer doubling.

Every text over the limit gets a table of boundaries: ends of paragraphs; inside
a paragraph too long for a piece, ends of sentences; inside such a sentence,
ends of words; inside a run without any, the borders between tokens that are
borders between characters.  Each boundary is joined to its farthest legal
successor, the overlap that the piece repeats included.  Squaring the successor
tables then yields all greedy cuts of all texts of a batch at once, in a number
of steps logarithmic in the number of pieces.

Texts within the limit, null and empty texts have no rows.  Pieces without
their overlap, joined in order, are the text.  Repeated rows are cut alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.tokenizer import DEFAULT_DIR, DEFAULT_NAME, clean, encoder
from mathquarry.session import worker_cache

PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*|\r\n?[ \t]*\r\n?\s*|\n\s*(?=#+ |[-*•] |\d+[.)] |\\\[|\\section)")
SENTENCE = re.compile(r"[.!?…]+[\"')\]]*(?=\s)|[。！？]+[」”]*|[;:](?=\s*\n)|\n+")
WORD = re.compile(r"\S(?=\s)|[，、；：,;)\]}]+(?=\S)")
SCHEMA = "doc_id long, piece int, char_start long, new_from long, char_end long, n_tokens int, n_repeated int, boundary string, text string"
KINDS = ("paragraph", "sentence", "word", "token", "end")


def token_bytes(enc, name: str) -> np.ndarray:
    cache = worker_cache()
    if ("bytes", name) not in cache:
        cache["bytes", name] = np.array(_lengths(enc), dtype=np.int64)
    return cache["bytes", name]


def _lengths(enc) -> list[int]:
    out = [0] * (enc.max_token_value + 1)
    for i in range(enc.max_token_value + 1):
        try:
            out[i] = len(enc.decode_single_token_bytes(i))
        except KeyError:
            pass
    return out


def boundaries(text: str, ids: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token positions, kinds, token positions that are borders of characters, the characters there).

    No two neighbouring boundaries are more than ``most`` tokens apart, unless a
    single character has more.
    """
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    if text.isascii():
        char_at = np.arange(len(text) + 1)
    else:
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        char_at = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))])
    at = np.searchsorted(char_at, ends)
    fits = char_at[np.minimum(at, len(text))] == ends
    aligned, chars = np.flatnonzero(fits), at[fits]

    def positions(pattern: re.Pattern, lo: int = 0, hi: int | None = None) -> np.ndarray:
        places = np.array([m.end() for m in pattern.finditer(text, lo, len(text) if hi is None else hi)], dtype=np.int64)
        k = np.searchsorted(chars, places)
        k = k[k < len(chars)]
        return aligned[k[chars[k] == places[: len(k)]]]

    n = len(ids)
    found = np.array([0, n])
    kinds = {0: 4, n: 4}
    for kind, pattern in enumerate((PARAGRAPH, SENTENCE, WORD, None)):
        gaps = np.flatnonzero(np.diff(found) > most)
        if not len(gaps):
            break
        new = []
        for g in gaps.tolist():
            lo, hi = int(found[g]), int(found[g + 1])
            if pattern is None:
                inner = aligned[np.searchsorted(aligned, lo, "right") : np.searchsorted(aligned, hi)]
            else:
                a, b = chars[np.searchsorted(aligned, lo)], chars[np.searchsorted(aligned, hi)]
                inner = positions(pattern, int(a), int(b))
                inner = inner[(inner > lo) & (inner < hi)]
            new.append(inner)
            for p in inner.tolist():
                kinds.setdefault(p, kind)
        found = np.unique(np.concatenate([found, *new]))
    return found, np.array([kinds[p] for p in found.tolist()]), aligned, chars


def successors(cuts: np.ndarray, aligned: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(where a piece with new content from each boundary begins, its farthest legal successor's index)."""
    start = aligned[np.searchsorted(aligned, np.maximum(cuts - overlap, 0))]
    start[0] = 0
    nxt = np.searchsorted(cuts, start + limit, "right") - 1
    last = len(cuts) - 1
    return start, np.minimum(np.maximum(nxt, np.arange(len(cuts)) + 1), last)


def reachable(nxt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks what can be reached from ``first`` by squaring the successor table."""
    marked = np.zeros(len(nxt), dtype=bool)
    marked[first] = True
    table = nxt
    while True:
        before = int(marked.sum())
        marked[table[marked]] = True
        if int(marked.sum()) == before:
            return marked
        table = table[table]


def _split(name: str, folder: str, limit: int, overlap: int):
    def run(batches):
        enc = encoder(name, folder)
        lengths = token_bytes(enc, name)
        for b in batches:
            docs, tables, base = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text or len(text.encode("utf-8", "surrogatepass")) <= limit:
                    continue
                text = clean(text)
                ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
                if len(ids) <= limit:
                    continue
                cuts, kinds, aligned, chars = boundaries(text, ids, lengths, limit - overlap)
                start, nxt = successors(cuts, aligned, limit, overlap)
                tables.append((base, nxt + base))
                docs.append((doc, text, cuts, kinds, aligned, chars, start))
                base += len(cuts)
            if not docs:
                continue
            marked = reachable(np.concatenate([t for _, t in tables]), np.array([s for s, _ in tables]))
            rows: list[tuple] = []
            for (at, _), (doc, text, cuts, kinds, aligned, chars, start) in zip(tables, docs):
                used = np.flatnonzero(marked[at : at + len(cuts)])
                char = lambda p: chars[np.searchsorted(aligned, p)]
                heads, tails = used[:-1], used[1:]
                a, m, z = char(start[heads]), char(cuts[heads]), char(cuts[tails])
                sizes, again = cuts[tails] - start[heads], cuts[heads] - start[heads]
                for k, (x, y, w, s, r, kind) in enumerate(zip(a.tolist(), m.tolist(), z.tolist(), sizes.tolist(), again.tolist(), kinds[tails].tolist())):
                    rows.append((doc, k, x, y, w, s, r, KINDS[kind], text[x:w]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))],
                names=["doc_id", "piece", "char_start", "new_from", "char_end", "n_tokens", "n_repeated", "boundary", "text"],
            )

    return run


def split_oversized(docs: DataFrame, limit: int, overlap: int, name: str = DEFAULT_NAME, folder: str = DEFAULT_DIR) -> DataFrame:
    """Ordered pieces of at most ``limit`` tokens of every text that has more.

    ``char_start`` and ``char_end`` bound the piece, ``new_from`` is where it
    goes beyond the piece before; ``n_repeated`` of its ``n_tokens`` tokens
    repeat that piece's end: ``overlap``, or as many fewer as keep characters
    whole.  ``boundary`` is the kind of the piece's end.
    """
    if limit - overlap < 8 or overlap < 0:
        raise ValueError("the limit must exceed the overlap by 8 tokens at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_split(name, folder, limit, overlap), SCHEMA)
