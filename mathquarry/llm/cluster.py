"""Problem 1: similarity clusters by bisecting k-means over the cluster.

A text is the unit vector of its distinct words, hashed to ``CELLS`` cells and
weighted by inverse document frequency over all records.  A node's compactness
is the mean cosine of its members to its centre, which is the length of the
mean member; its dispersion is size times one minus that.  The tree starts with
all records in one node; nodes that break the compactness limits are split, the
largest dispersion first, until none is left.  As the limits look at a node
alone, the order doesn't change the leaves, so all nodes of a round are split by
the same passes.

A split starts from the best of several two-means runs on a bounded sample of
the node's rows, one node's runs in one task; these centres are only where the
passes over all rows begin.  Each pass assigns every row of the open nodes to
the nearer of its node's two centres and adds up the new ones: partial sums per
task, their sum per child by a shuffle, one vector per child to the driver.  A
split whose centres have come to rest takes no part in further passes.  After a
round the rows of finished leaves leave the working table, which is stored in
the shared folder.

A row's cluster is the leaf whose centre is nearest: a last step of k-means over
all leaves, which mends what an early split has cut apart.

Null and empty texts and texts without words are in no cluster.  Repeated
records count once.  No records, no leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mathquarry.llm.words import words
from mathquarry.session import discard, materialize

CELLS = 8192


@dataclass(frozen=True)
class Limits:
    """A node as compact as ``tight`` is a leaf.  So is one as compact as ``loose`` whose best split takes away
    less of its dispersion than ``least_gain`` and what a split of so few rows takes away by chance, ``chance``
    by their number.  No limit knows the size of the table, and none closes a node for being small."""

    loose: float = 0.25
    tight: float = 0.75
    least_gain: float = 0.04
    chance: float = 2.5
    rest: float = 0.99  # cosine of a centre before and after a pass from which on it is at rest
    passes: int = 8  # over the rows of one split at most; the centres of the last one stand
    sample: int = 1024  # rows on which a split's first centres are found
    block: int = 256  # open nodes in one pass, for the memory that their centres and sums take


@dataclass
class Tree:
    """Nodes by number; node 0 is the root.  ``sums`` has the leaves' totals, 32 KB each."""

    idf: np.ndarray
    sizes: dict[int, int] = field(default_factory=dict)
    compact: dict[int, float] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)

    def leaves(self) -> list[int]:
        return [n for n in self.sizes if n not in self.children and self.sizes[n]]


class Cells(dict):
    """The cell of each word, hashed once while the dictionary is small."""

    def __missing__(self, word: str) -> int:
        cell = xxhash.xxh3_64_intdigest(word) % CELLS
        if len(self) < 200_000:
            self[word] = cell
        return cell


def cells_of(text: str | None, known: Cells | None = None) -> np.ndarray:
    known = Cells() if known is None else known
    return np.array(sorted({known[w] for w in words(text)}), dtype="<u2")


def _vectors(batches):
    """The key columns and the cells of the text."""
    known = Cells()
    for b in batches:
        blobs = [cells_of(t, known).tobytes() for t in b.column("text").to_pylist()]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(blobs, pa.binary())], names=[*names, "cells"])


class Rows:
    """Rows of an Arrow batch as one sparse matrix."""

    def __init__(self, column: pa.Array, idf: np.ndarray):
        n = len(column)
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64) // 2
        self.cells = np.frombuffer(data, dtype="<u2")[o[0] : o[-1]] if data is not None and n else np.zeros(0, dtype="<u2")
        self.starts, self.counts = o[:-1] - o[0], np.diff(o)
        self.row = np.repeat(np.arange(n), self.counts)
        value = idf[self.cells]
        norm = np.sqrt(self.add(value * value))
        norm[norm == 0] = 1
        self.value = (value / norm[self.row]).astype(np.float32)

    def add(self, per_cell: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=per_cell, minlength=len(self.counts))

    def dot(self, matrix: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Each row times its row of ``matrix``."""
        return self.add(self.value * matrix[which[self.row], self.cells])

    def sums(self, group: np.ndarray, n: int) -> np.ndarray:
        """Sum of the rows of each group; rows of group -1 are left out."""
        g = group[self.row]
        keep = g >= 0
        at = g[keep].astype(np.int64) * CELLS + self.cells[keep]
        return np.bincount(at, weights=self.value[keep], minlength=n * CELLS).reshape(n, CELLS)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _document_frequency(batches):
    total = np.zeros(CELLS, dtype=np.int64)
    n = 0
    for b in batches:
        c = b.column(0)
        n += len(c)
        _, offsets, data = c.buffers()
        o = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1] // 2
        if data is not None and len(c):
            total += np.bincount(np.frombuffer(data, dtype="<u2")[o[0] : o[-1]], minlength=CELLS)
    yield pa.RecordBatch.from_arrays([pa.array([*range(CELLS), CELLS], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["cell", "n"])


def idf_table(rows: DataFrame, block: int = 256) -> np.ndarray:
    """Weights of the cells, CELLS numbers: log((2 + n) / (1 + df)), 0 only for cells in no record.

    A cell in more than a tenth of the records may be filler or the mark of a
    large subject; ``told`` finds out, over all records, ``block`` cells in one pass.
    """
    counts = rows.select("cells").mapInArrow(_document_frequency, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(CELLS + 1, dtype=np.int64)
    df[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    n, df = int(df[CELLS]), df[:CELLS]
    idf = np.where(df > 0, np.log((2 + n) / (1 + df)), 0.0)
    common = np.flatnonzero(df * 10 > n)
    # halves by a hash of the whole record, so that copies of one text fall on both sides
    drawn = rows.filter("length(cells) > 0").select(F.pmod(F.xxhash64(*rows.columns), F.lit(2)).cast("int").alias("half"), "cells")
    for i in range(0, len(common), block):
        part = common[i : i + block]
        shared = rows.sparkSession.sparkContext.broadcast((part, idf, df, n))
        sums = drawn.mapInArrow(_beside(shared), "cell int, half int, counts binary").repartition(min(len(part), 32), "cell")
        factor = {r["cell"]: r["factor"] for r in sums.mapInArrow(_tell(shared), "cell int, factor double").collect()}
        idf[part] *= [factor[c] for c in part.tolist()]
        shared.unpersist()
    return idf


def _beside(shared):
    """Of each half of the records and each common cell: in how many of the records with it each cell is."""

    def run(batches):
        common, _, _, _ = shared.value
        place = np.full(CELLS, -1, dtype=np.int64)
        place[common] = np.arange(len(common))
        total = np.zeros(2 * len(common) * CELLS, dtype=np.int64)
        for b in batches:
            rows = Rows(b.column("cells"), np.ones(CELLS))
            at = np.flatnonzero(place[rows.cells] >= 0)  # each common cell of each row ..
            row = rows.row[at]
            n = rows.counts[row]
            first = np.cumsum(n) - n
            other = np.arange(n.sum()) - np.repeat(first - rows.starts[row], n)  # .. with all cells of the row
            base = (2 * place[rows.cells[at]] + b.column("half").to_numpy()[row]) * CELLS
            total += np.bincount(np.repeat(base, n) + rows.cells[other], minlength=len(total))
        total = total.reshape(-1, CELLS)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(common[used // 2], pa.int32()), pa.array(used % 2, pa.int32()), pa.array([total[u].tobytes() for u in used], pa.binary())], names=["cell", "half", "counts"])

    return run


def _tell(shared):
    def run(batches):
        _, idf, df, n = shared.value
        halves: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, half, counts in zip(*(c.to_pylist() for c in b.columns)):
                halves.setdefault(cell, np.zeros((2, CELLS)))[half] += np.frombuffer(counts, dtype=np.int64)
        found = [(cell, told(cell, both, idf, df, n)) for cell, both in halves.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())], names=["cell", "factor"])

    return run


def told(cell: int, halves: np.ndarray, idf: np.ndarray, df: np.ndarray, n: int, low: float = 0.1, high: float = 0.15, floor: float = 0.05) -> float:
    """``floor`` for a common cell that is filler, 1 for one that marks a subject, between them by a ramp.

    The words beside filler are those of the whole table; the words beside a
    mark are those of its subject.  The measure is the relative entropy of the
    two, as a share of the most that so common a cell can have.  In few records
    chance adds to it; taken from one half and tried on the other, it loses as
    much, so the mean of both ways counts.
    """
    halves, share = halves * idf, df * idf
    halves[:, cell] = share[cell] = 0
    share = share / max(share.sum(), 1e-12)
    if min(halves.sum(axis=1)) <= 0 or df[cell] == n:
        return floor
    both = halves.sum(axis=0) / halves.sum()
    found = float((both * np.log(np.maximum(both, 1e-12) / np.maximum(share, 1e-12)))[both > 0].sum()) / 2
    for one, other in (halves, halves[::-1]):
        seen = other + share * idf.max() * 20  # a few records of the whole table for what the half lacks
        ratio = np.log(np.maximum(seen / seen.sum(), 1e-12) / np.maximum(share, 1e-12))
        found += float((one / one.sum() * ratio)[one > 0].sum()) / 4
    found /= np.log((1 + n) / df[cell])
    return float(np.clip((found - low) / (high - low), floor, 1.0))


def _position(nodes: list[int]) -> np.ndarray:
    at = np.full(max(nodes) + 1, -1, dtype=np.int64)
    at[nodes] = np.arange(len(nodes))
    return at


def _partial_sums(shared):
    """One pass: (child, n, sum) of each task, the child being twice the node's place plus its side."""

    def run(batches):
        nodes, centres, idf = shared.value
        at, k = _position(nodes), len(nodes)
        side = None if centres is None else centres[:, 0] - centres[:, 1]
        sums, sizes = np.zeros((2 * k, CELLS)), np.zeros(2 * k, dtype=np.int64)
        for b in batches:
            place = at[b.column("node").to_numpy()]
            rows = Rows(b.column("cells"), idf)
            child = 2 * place + (0 if side is None else rows.dot(side, place) <= 0)
            sums += rows.sums(child, 2 * k)
            sizes += np.bincount(child, minlength=2 * k)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sizes[used], pa.int64()), pa.array([sums[u].astype(np.float32).tobytes() for u in used], pa.binary())], names=["child", "n", "total"])

    return run


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for b in batches:
        for child, n, total in zip(*(c.to_pylist() for c in b.columns)):
            v = np.frombuffer(total, dtype=np.float32)
            sums[child] = sums[child] + v if child in sums else v.astype(np.float64)
            sizes[child] = sizes.get(child, 0) + n
    keys = list(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sizes[k] for k in keys], pa.int64()), pa.array([sums[k].astype(np.float32).tobytes() for k in keys], pa.binary())], names=["child", "n", "total"])


SUMS = "child int, n long, total binary"


def _one_pass(rows: DataFrame, nodes: list[int], centres: np.ndarray | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, sums) of the children; two for each open node."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((nodes, None if centres is None else centres.astype(np.float32), idf))
    part = rows.mapInArrow(_partial_sums(shared), SUMS)
    whole = part.repartition(min(2 * len(nodes), 64), "child").mapInArrow(_add_up, SUMS).collect()
    sizes, sums = np.zeros(2 * len(nodes), dtype=np.int64), np.zeros((2 * len(nodes), CELLS))
    for r in whole:
        sizes[r["child"]] = r["n"]
        sums[r["child"]] = np.frombuffer(r["total"], dtype=np.float32)
    shared.unpersist()
    return sizes, sums


def _advance(shared):
    """Rows of the open nodes move to the children; those of finished leaves go."""

    def run(batches):
        nodes, centres, children, idf = shared.value
        at = _position(nodes)
        side = centres[:, 0] - centres[:, 1]
        for b in batches:
            node = b.column("node").to_numpy()
            place = at[np.minimum(node, len(at) - 1)]
            place[node >= len(at)] = -1
            safe = np.maximum(place, 0)
            new = children[safe, (Rows(b.column("cells"), idf).dot(side, safe) <= 0).astype(int)]
            keep = pa.array((place >= 0) & (new >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int32)).filter(keep), b.column("pick").filter(keep), b.column("cells").filter(keep)], names=["node", "pick", "cells"])

    return run


def _sampled(rows: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """About ``most`` rows of each node, chosen by ``pick``, a hash of the whole record: copies of one text are drawn one by one.

    No set of words makes up more than ``Limits.tight`` of an open node, so a sample of one set only is out of the question.
    """
    shares = [0.0] * (max(sizes) + 1)
    for node, n in sizes.items():
        shares[node] = min(1.0, most / max(n, 1))
    share = F.get(F.lit(shares), F.col("node"))
    return rows.filter(F.pmod("pick", F.lit(1 << 40)) < share * (1 << 40)).select("node", "cells")


def _seeded(shared):
    """The two first centres of each node whose sample comes in; a task has at most ``Limits.block`` samples, of bounded size."""

    def run(batches):
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for node, cells in zip(b.column("node").to_pylist(), b.column("cells").to_pylist()):
                blobs.setdefault(node, []).append(cells)
        for node, mine in blobs.items():
            if len(mine) > 1:
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([seeds(mine, shared.value).astype(np.float32).tobytes()], pa.binary())], names=["node", "centres"])

    return run


def seeds(blobs: list[bytes], idf: np.ndarray, runs: int = 6, steps: int = 8) -> np.ndarray:
    """Two centres: the best of several two-means runs on a few rows, each from two rows that are unlike."""
    rows = Rows(pa.array(sorted(blobs), pa.binary()), idf)
    n = len(blobs)
    rng = np.random.default_rng(n)
    best, found = -1.0, np.zeros((2, CELLS))
    zero = np.zeros(n, dtype=np.int64)
    for _ in range(runs):
        a = rows.sums(np.where(np.arange(n) == rng.integers(n), 0, -1), 1)
        unlike = np.flatnonzero(rows.dot(a, zero) < 1 - 1e-6)
        if not len(unlike):
            continue
        centres = np.stack([a[0], rows.sums(np.where(np.arange(n) == rng.choice(unlike), 0, -1), 1)[0]])
        for _ in range(steps):
            side = (rows.dot((centres[0] - centres[1])[None], zero) <= 0).astype(np.int64)
            sums = rows.sums(side, 2)
            centres = unit(sums)
        goal = float(np.linalg.norm(sums, axis=1).sum())
        if goal > best:
            best, found = goal, centres
    return found


def bisect(vectors: DataFrame, limits: Limits = Limits()) -> Tree:
    """The tree over stored ``vectors`` (with a column cells)."""
    tree = Tree(idf_table(vectors))
    rows = vectors.filter("length(cells) > 0").select(F.lit(0).alias("node"), F.xxhash64(*vectors.columns).alias("pick"), "cells")
    if not tree.idf.any():
        return tree
    size, total = _one_pass(rows, [0], None, tree.idf)
    if not size[0]:
        return tree
    _note(tree, 0, int(size[0]), total[0])
    may = lambda n: tree.compact[n] < limits.tight
    opened = [0] if may(0) else []
    while opened:
        # the largest dispersion first
        opened.sort(key=lambda n: -tree.sizes[n] * (1 - tree.compact[n]))
        blocks = [opened[i : i + limits.block] for i in range(0, len(opened), limits.block)]
        parts = [_split(rows if len(blocks) == 1 else rows.filter(F.col("node").isin(b)), b, tree, limits, may) for b in blocks]
        opened = [n for following, _ in parts for n in following]
        if not opened:
            break
        before, rows = rows, materialize(reduce(DataFrame.unionAll, [moved for following, moved in parts if following]), "open")
        discard(before)
    discard(rows)
    return tree


def _split(rows: DataFrame, opened: list[int], tree: Tree, limits: Limits, may: Callable[[int], bool]) -> tuple[list[int], DataFrame]:
    """Splits the nodes ``opened``, which hold ``rows``: the children that are open, and the rows in them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tree.idf)
    seeded = _sampled(rows, {n: tree.sizes[n] for n in opened}, limits.sample).repartition(min(len(opened), 64), "node").mapInArrow(_seeded(shared), "node int, centres binary")
    place = {n: i for i, n in enumerate(opened)}
    centres = np.zeros((len(opened), 2, CELLS))
    for r in seeded.collect():
        centres[place[r["node"]]] = np.frombuffer(r["centres"], dtype=np.float32).reshape(2, CELLS)
    used, sizes, sums = centres.copy(), np.zeros(2 * len(opened), dtype=np.int64), np.zeros((2 * len(opened), CELLS))
    moving = np.arange(len(opened))
    for _ in range(limits.passes):
        nodes = [opened[i] for i in moving]
        at = np.stack([2 * moving, 2 * moving + 1], axis=1).ravel()
        used[moving] = centres[moving]
        sizes[at], sums[at] = _one_pass(rows if len(moving) == len(opened) else rows.filter(F.col("node").isin(nodes)), nodes, used[moving], tree.idf)
        centres[moving] = unit(sums[at]).reshape(-1, 2, CELLS)
        moving = moving[(used[moving] * centres[moving]).sum(axis=2).min(axis=1) < limits.rest]
        if not len(moving):
            break
    children = np.full((len(opened), 2), -1, dtype=np.int64)
    following = []
    for i, n in enumerate(opened):
        own, parts = np.linalg.norm(tree.sums[n]), np.linalg.norm(sums[2 * i : 2 * i + 2], axis=1)
        gain = (parts.sum() - own) / max(tree.sizes[n] - own, 1e-9)
        if min(sizes[2 * i : 2 * i + 2]) == 0 or tree.compact[n] >= limits.loose and gain < limits.least_gain + limits.chance / tree.sizes[n]:
            continue
        a, b = len(tree.sizes), len(tree.sizes) + 1
        tree.children[n] = (a, b)
        for c, j in ((a, 2 * i), (b, 2 * i + 1)):
            _note(tree, c, int(sizes[j]), sums[j])
            if may(c):
                following.append(c)
                children[i, j - 2 * i] = c
        del tree.sums[n]
    shared = spark.sparkContext.broadcast((opened, used.astype(np.float32), children, tree.idf))
    return following, rows.mapInArrow(_advance(shared), "node int, pick long, cells binary")


def _note(tree: Tree, node: int, size: int, total: np.ndarray) -> None:
    tree.sizes[node], tree.sums[node], tree.compact[node] = size, total.astype(np.float32), float(np.linalg.norm(total)) / max(size, 1)


def _products(rows: Rows, table: np.ndarray, weighted: bool, most: int = 1 << 22) -> Iterator[tuple[slice, np.ndarray]]:
    """Parts of the rows with their products with all columns of ``table`` (CELLS x columns), ``most`` numbers at a time; every row has cells."""
    step = max(1, most // max(table.shape[1], 1))
    ends = np.append(rows.starts, len(rows.cells))
    first = 0
    while first < len(rows.counts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, side="right")) - 1)
        a, z = ends[first], ends[last]
        part = table[rows.cells[a:z]]
        yield slice(first, last), np.add.reduceat(part * rows.value[a:z, None] if weighted else part, ends[first:last] - a, axis=0)
        first = last


def nearest_centre(rows: Rows, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of ``centres`` (CELLS x leaves) with the largest cosine and that cosine, for each row."""
    best, cosine = np.zeros(len(rows.counts), dtype=np.int64), np.zeros(len(rows.counts))
    for part, found in _products(rows, centres, True):
        best[part] = found.argmax(axis=1)
        cosine[part] = found[np.arange(len(found)), best[part]]
    return best, cosine


def centres_of(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the leaves and their centres as columns, in single precision."""
    leaves = np.array(sorted(tree.leaves()), dtype=np.int64)
    centres = np.stack([tree.sums[n] for n in leaves.tolist()]) if len(leaves) else np.zeros((1, CELLS))
    return leaves, np.ascontiguousarray(unit(centres).T.astype(np.float32))


def assign(vectors: DataFrame, tree: Tree) -> DataFrame:
    """``vectors`` with words: the key columns, ``cluster`` (the leaf with the nearest centre) and ``cosine`` to it."""
    shared = vectors.sparkSession.sparkContext.broadcast((*centres_of(tree), tree.idf))
    keys = [f for f in vectors.schema.fields if f.name != "cells"]
    names = [f.name for f in keys]

    def run(batches):
        leaves, centres, idf = shared.value
        for b in batches:
            best, cosine = nearest_centre(Rows(b.column("cells"), idf), centres)
            leaf = leaves[best] if len(leaves) else best
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(leaf.astype(np.int32)), pa.array(np.round(cosine, 6))], names=[*names, "cluster", "cosine"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", cluster int, cosine double"
    return vectors.filter("length(cells) > 0").mapInArrow(run, schema)


def vectors_of(records: DataFrame, *keys: str) -> DataFrame:
    """Stored table of the distinct ``records``: their key columns and the cells of their column text; other columns are left out."""
    schema = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys) + ", cells binary"
    return materialize(records.select(*keys, "text").mapInArrow(_vectors, schema).distinct(), "vectors")


# ---------------------------------------------------------------- exemplars


@dataclass
class Subjects:
    """Groups of leaves alike, what each word says about them, and the exemplar of each group or None."""

    exemplars: list[int | None]
    weights: np.ndarray  # groups x CELLS: how much a word speaks for a group
    group: dict[int, int]  # the group of each leaf


def subjects(tree: Tree, examples: dict[int, str], alike: float = 0.5, least: float = 0.2) -> Subjects:
    """Joins leaves whose centres have a cosine of at least ``alike``, the most alike first, and gives each exemplar the group of its nearest leaf.

    A link that would bring two exemplars into one group is cut.  Of exemplars
    with the same nearest leaf only the nearest gets it.

    A word speaks for a group by its share in the group's texts against the sum
    of its shares in all groups, the more, the fewer groups it is typical of.
    """
    leaves = sorted(tree.leaves(), key=lambda n: -tree.sizes[n])
    centres = unit(np.stack([tree.sums[n] for n in leaves]))
    home: dict[int, tuple[float, int]] = {}  # place of a leaf: its exemplar
    for number, text in examples.items():
        cells = cells_of(text)
        v = np.zeros(CELLS)
        v[cells] = tree.idf[cells]
        cosines = centres @ unit(v)
        i = int(cosines.argmax())
        if cosines[i] >= least and cosines[i] > home.get(i, (0.0, 0))[0]:
            home[i] = (float(cosines[i]), number)
    group = list(range(len(leaves)))
    owner = {i: number for i, (_, number) in home.items()}
    near = np.triu(centres @ centres.T, 1)
    links = np.argwhere(near >= alike)
    for i, j in links[np.argsort(-near[links[:, 0], links[:, 1]], kind="stable")].tolist():
        old, new = max(group[i], group[j]), min(group[i], group[j])
        if old != new and not (old in owner and new in owner):
            group = [new if g == old else g for g in group]
            if old in owner:
                owner[new] = owner.pop(old)
    names = sorted(set(group))
    sums = np.stack([sum(tree.sums[n] for n, g in zip(leaves, group) if g == name) for name in names])
    sizes = np.array([sum(tree.sizes[n] for n, g in zip(leaves, group) if g == name) for name in names], dtype=float)
    # a word's share in a group, smoothed by one text of usual size
    shares = sums / sizes[:, None]
    floor = np.median(sizes)
    typical = shares + (shares.max(axis=0) / max(floor, 1))[None]
    given = typical / np.maximum(typical.sum(axis=0), 1e-12)
    entropy = -(given * np.log(np.maximum(given, 1e-12))).sum(axis=0) / np.log(max(len(names), 2))
    weights = (given * np.maximum(0.0, 1 - entropy)).astype(np.float32)
    found = [owner.get(name) for name in names]
    return Subjects(found, weights, {n: names.index(g) for n, g in zip(leaves, group)})


def belongs(vectors: DataFrame, tree: Tree, found: Subjects, rival: float = 0.6, least: float = 1.0) -> DataFrame:
    """The key columns and ``exemplar_id`` of the rows of an exemplar's cluster that are mainly about its subject.

    A row's cluster is the leaf whose centre is nearest, as in ``assign``, and with it a
    group of leaves and perhaps an exemplar.  A check of the words follows: the evidence
    for a group is the sum of what the row's words say for it.  The row's own group must
    have most of it and ``least`` or more, the next group no more than ``rival`` of that;
    else the row deals with several subjects alike or with none.
    """
    keys = [f for f in vectors.schema.fields if f.name != "cells"]
    names = [f.name for f in keys]
    leaves, centres = centres_of(tree)
    weights = np.where(tree.idf > 0, found.weights, 0).T.astype(np.float32).copy()
    numbers = np.array([-1 if e is None else e for e in found.exemplars], dtype=np.int32)
    group = np.array([found.group[n] for n in leaves.tolist()], dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((centres, group, weights, numbers, tree.idf))

    def run(batches):
        centres, group, table, known, idf = shared.value
        for b in batches:
            rows = Rows(b.column("cells"), idf)
            own = group[nearest_centre(rows, centres)[0]]
            keep = np.zeros(len(own), dtype=bool)
            for part, evidence in _products(rows, table, False):
                mine, at = own[part], np.arange(len(evidence))
                most = evidence[at, mine]
                evidence[at, mine] = 0
                keep[part] = (most >= least) & (evidence.max(axis=1) <= rival * most) & (known[mine] >= 0)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(n).filter(mask) for n in names), pa.array(known[own][keep], pa.int32())], names=[*names, "exemplar_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", exemplar_id int"
    return vectors.filter("length(cells) > 0").mapInArrow(run, schema)


def nearest(assigned: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` rows of each cluster with the largest cosine, ties by ``keys``; each task first keeps its own ``k``."""
    fields = [assigned.schema[c] for c in (*keys, "cluster", "cosine")]

    def run(batches):
        best: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(f.name).to_pylist() for f in fields)):
                mine = best.setdefault(row[-2], [])
                mine.append((-row[-1], *(x is not None for x in row[:-2]), *(x if x is not None else "" for x in row[:-2]), row))
                if len(mine) > 50 * k:
                    mine.sort(key=lambda r: r[:-1])
                    del mine[k:]
        rows = [r[-1] for mine in best.values() for r in sorted(mine, key=lambda r: r[:-1])[:k]]
        if rows:
            yield pa.RecordBatch.from_pydict({f.name: list(c) for f, c in zip(fields, zip(*rows))}, schema=pa.schema([(f.name, _arrow(f)) for f in fields]))

    few = assigned.select(*(f.name for f in fields)).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    order = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("cosine"), *keys))
    return few.withColumn("place", order).filter(F.col("place") <= k)


def _arrow(f) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]
