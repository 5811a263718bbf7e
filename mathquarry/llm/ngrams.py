"""Problem 2: frequencies of all n-grams by suffix sorting.

Every position of a record gives the suffix that begins there, cut after
``sigma`` terms.  Equal suffixes are counted together, a block of records at a
time, before the one shuffle, which routes them by their first term (and a part
of their second, so that no first term is one task).  There they are sorted in
reverse lexicographic order and read once with a stack that holds the counts of
the prefixes of the current suffix; a prefix leaves it with its final counts as
soon as a suffix without it comes.  Suffixes of a batch are worked off together:
what leaves the stack within a batch are runs of one prefix, added up as such,
and what is still on it waits for the next batch.

Record sets need no lists of records: a suffix carries, for each length, in how
many records its prefix of that length occurs there for the first time.  These
numbers add up over suffixes to the exact number of records of each prefix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathquarry.session import materialize

SALTS = 16
#: Between the terms of an n-gram; lower than any character of a term, so that an n-gram sorts next to its extensions.
MARK = "\u0001"


#: Positions that are counted together before a shuffle.
BLOCK = 1 << 21


def _suffixes(terms_of: Callable[[str | None], list[str]], sigma: int):
    """Batches of one text column to rows (suffix, n, d1 .. d_sigma); the empty suffix counts the records."""
    names = ["suffix", "n", *(f"d{i}" for i in range(1, sigma + 1))]

    def run(batches):
        known: dict[str, int] = {}
        terms: list[int] = []
        lengths: list[int] = []
        for b in batches:
            for text in b.column(0).to_pylist():
                found = terms_of(text)
                lengths.append(len(found))
                terms += [known.setdefault(t, len(known)) for t in found]
                if len(terms) >= BLOCK:
                    yield _counted(known, terms, lengths, sigma, names)
                    known, terms, lengths = {}, [], []
        if lengths:
            yield _counted(known, terms, lengths, sigma, names)

    return run


def _counted(known: dict[str, int], terms: list[int], lengths: list[int], sigma: int, names: list[str]) -> pa.RecordBatch:
    """The distinct suffixes of a block of records."""
    at, record = np.array(terms, dtype=np.int64), np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(at))  # terms from the position to the record's end
    prefix = np.zeros(len(at), dtype=np.int64)  # a number for each distinct prefix of the length reached
    first: list[np.ndarray] = []
    for k in range(sigma):
        there = left > k
        term = np.where(there, np.concatenate([at[k:], np.zeros(min(k, len(at)), dtype=np.int64)])[: len(at)] + 1, 0)
        _, prefix = np.unique(prefix * (len(known) + 1) + term, return_inverse=True)
        spots = np.flatnonzero(there)
        _, new = np.unique(record[spots] * (len(at) + 1) + prefix[spots], return_index=True)
        first.append(spots[new])
    _, sample, n = np.unique(prefix, return_index=True, return_counts=True)
    vocabulary = pa.array(list(known), pa.string())
    suffix = vocabulary.take(pa.array(at[sample]))
    for k in range(1, sigma):
        more = left[sample] > k
        following = vocabulary.take(pa.array(np.where(more, at[np.minimum(sample + k, len(at) - 1)], 0))) if len(at) else suffix
        suffix = pc.if_else(pa.array(more), pc.binary_join_element_wise(suffix, following, MARK), suffix)
    records = [np.bincount(prefix[f], minlength=len(n)) for f in first]
    head = [[""], [len(lengths)], *([0] for _ in first)]
    body = [suffix, pa.array(n), *map(pa.array, records)]
    columns = [pa.concat_arrays([pa.array(h, pa.string() if i == 0 else pa.int64()), x.cast(pa.string() if i == 0 else pa.int64())]) for i, (h, x) in enumerate(zip(head, body))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _stack(sigma: int, longest: int):
    """Suffixes in reverse lexicographic order to (ngram, n_terms, n_occurrences, n_records) of all their prefixes of up to ``longest`` terms."""

    def run(batches):
        held: dict[int, tuple[str, int, int]] = {}  # by length: the prefix that is still open, its counts so far
        for b in batches:
            text = b.column(0)
            none = pc.equal(text, "")
            out = [("", 0, c, c) for c in b.column(1).filter(none).to_pylist()]
            b = b.filter(pc.invert(none))
            n = b.column(1).to_numpy()
            terms = pc.split_pattern(b.column(0), MARK)
            depth = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(depth) - depth
            flat = terms.flatten().dictionary_encode()
            codes, values = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
            prefix, label = np.zeros(len(depth), dtype=np.int64), None
            for k in range(1, min(sigma, longest) + 1):
                rows = np.flatnonzero(depth >= k)
                if not len(rows):
                    break
                term = codes[begin[rows] + k - 1]
                prefix = prefix[rows] if k == 1 else prefix[np.searchsorted(before, rows)]
                word = values.take(pa.array(term))
                label = word if k == 1 else pc.binary_join_element_wise(label.take(pa.array(np.searchsorted(before, rows))), word, MARK)
                # runs of one prefix: suffixes with it stand together
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (prefix[1:] != prefix[:-1]) | (term[1:] != term[:-1])
                starts = np.flatnonzero(new)
                counts, records = np.add.reduceat(n[rows], starts), np.add.reduceat(b.column(k + 1).to_numpy()[rows], starts)
                names = label.take(pa.array(starts)).to_pylist()
                if k in held:
                    name, c, r = held.pop(k)
                    if name == names[0]:
                        counts[0] += c
                        records[0] += r
                    else:
                        out.append((name, k, c, r))
                held[k] = (names[-1], int(counts[-1]), int(records[-1]))
                out += zip(names[:-1], [k] * (len(names) - 1), counts[:-1].tolist(), records[:-1].tolist())
                prefix, before = np.cumsum(new), rows
            if out:
                yield _rows(out)
        if held:
            yield _rows([(name, k, c, r) for k, (name, c, r) in held.items()])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["ngram", "n_terms", "n_occurrences", "n_records"])

    return run


def ngram_counts(texts: DataFrame, terms_of: Callable[[str | None], list[str]], sigma: int, longest: int | None = None) -> DataFrame:
    """(ngram, n_terms, n_occurrences, n_records) of all n-grams of 1 to ``sigma`` terms, joined by MARK; only those of up to ``longest``, if it is given.

    ``texts`` has one string column and one row for each record.  The empty
    n-gram is there too (the result is stored); both its numbers are the number of records, those without
    terms included.  Null and empty texts have no terms.  No records, no rows.
    """
    d = [f"d{i}" for i in range(1, sigma + 1)]
    schema = T.StructType([T.StructField("suffix", T.StringType()), *(T.StructField(c, T.LongType()) for c in ["n", *d])])
    counted = texts.select(F.col(texts.columns[0]).cast("string")).mapInArrow(_suffixes(terms_of, sigma), schema)
    first, two = F.substring_index("suffix", MARK, 1), F.substring_index("suffix", MARK, 2)
    routed = counted.repartition(first, F.when(first != two, F.pmod(F.xxhash64(two), F.lit(SALTS))))
    ordered = routed.sortWithinPartitions(F.col("suffix").desc())
    rows = materialize(ordered.mapInArrow(_stack(sigma, longest or sigma), "ngram string, n_terms int, n_occurrences long, n_records long"), "ngrams")
    # A single term comes from each part of its second terms; longer n-grams come from one.
    single = rows.filter("n_terms <= 1").groupBy("ngram", "n_terms").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    return rows.filter("n_terms > 1").unionByName(single)
