"""Spatial partitioning of points and the block pairs that may hold neighbours.

One split tree, fitted on a bounded sample, names every point's leaf in one projection.  Leaves get their exact
bounding boxes from all points.  Pairs of tree nodes are walked from the root: a pair wholly beyond the radius is
dropped, a pair wholly within it is settled in bulk, and only undecided pairs of leaves are compared.  A leaf of
more than ``BLOCK`` points is dealt into blocks by a hash, so a group of two blocks is bounded whatever the data.

A point goes to the groups of the leaves whose box is within the radius of the point itself (its halo), not to all
groups of its own leaf.  Distances are one matrix product per group inside a task; no pair becomes a row.

What the driver holds is bounded by the number of leaves (``MAX_LEAVES``, and ``MAX_NUMBERS`` for their boxes) and
the sample.  The tree only decides how work is dealt; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
MAX_LEAVES, MAX_NUMBERS, SAMPLE_PER_LEAF = 8192, 500_000, 32
# Where radii reach most leaves a point would go to one group a leaf: blocks then grow until it goes to about this many,
# up to a block of BLOCK_BYTES (tasks hold two, and compare them slab by slab).
COPIES, BLOCK_BYTES = 16, 64 << 20
SLAB = 1024


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder; leaves are numbered in order, so a node's leaves are ``first <= leaf < last``."""
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return self.first[at]
            node = at[inner]
            low = x[inner, self.dim[node]] <= self.cut[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Splits at the median of the widest coordinate until a node has its share of the sample."""
    most = max(1, len(sample) // max(leaves, 1))
    nodes: list[list] = []

    def grow(rows: np.ndarray, done: int) -> tuple[int, int]:
        me = len(nodes)
        nodes.append([0, 0.0, -1, -1, done, done + 1])
        if len(rows) > most:
            x = sample[rows]
            dim = int((x.max(axis=0) - x.min(axis=0)).argmax())
            cut = float(np.median(x[:, dim]))
            low = x[:, dim] <= cut
            if low.all():
                cut = float(x[:, dim][x[:, dim] < cut].max(initial=-np.inf))
                low = x[:, dim] <= cut
            if low.any() and not low.all():
                left, done = grow(rows[low], done)
                right, done = grow(rows[~low], done)
                nodes[me][:4] = dim, cut, left, right
                nodes[me][5] = done
                return me, done
        return me, done + 1

    grow(np.arange(len(sample)), 0)
    dim, cut, left, right, first, last = zip(*nodes, strict=True)
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right), np.array(first), np.array(last))


def _gaps(lo_a, hi_a, lo_b, hi_b):
    """Squared smallest and largest distances between boxes."""
    near = np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    far = np.maximum(hi_b - lo_a, hi_a - lo_b)
    return (near * near).sum(axis=-1), (far * far).sum(axis=-1)


@dataclass(frozen=True)
class Blocks:
    """The dealt points: stored ``idx, w, x`` (little-endian doubles), ``leaf``, and what is known of the leaves."""
    points: DataFrame
    d: int
    radii: tuple[float, ...]
    lo: np.ndarray
    hi: np.ndarray
    weight: np.ndarray  # per leaf
    chop: np.ndarray  # blocks of each leaf
    near: tuple[np.ndarray, ...]  # per leaf: leaves it is compared with, itself included
    bulk: tuple[tuple[tuple[int, int], tuple[int, int], tuple[bool, ...]], ...]  # leaf ranges wholly within radii
    compared: int  # upper bound of compared pairs

    def opened(self) -> Blocks:
        """The same with nothing settled in bulk: those leaf pairs are compared too."""
        near = [set(x.tolist()) for x in self.near]
        for (a0, a1), (b0, b1), _ in self.bulk:
            for i, j in product(range(a0, a1), range(b0, b1)):
                near[i].add(j)
                near[j].add(i)
        return replace(self, near=tuple(np.array(sorted(x), np.int64) for x in near), bulk=())

    def deal(self, points: DataFrame, others: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
        """``points`` (those of this structure, with any extra columns) once for every group they belong to:
        columns ``p``, ``q``, ``b`` (the point's own block) are added.  With ``others``, groups of a block with itself
        are left out; with ``wanted`` (a flag per block) a point whose column ``open`` is false goes only to groups
        with such a block."""
        lo, hi, near, chop, d = self.lo, self.hi, self.near, self.chop, self.d
        start = np.concatenate([[0], np.cumsum(chop)])
        reach2 = max(self.radii) ** 2 * (1 + 1e-9)
        names = points.columns

        def run(batches):
            for batch in batches:
                leaf = batch.column("leaf").to_numpy()
                idx = batch.column("idx").to_numpy()
                x = vectors(batch.column("x"), d)
                own = start[leaf] + idx % chop[leaf]
                take, other = [], []
                for n in np.unique(leaf):
                    of_leaf = np.flatnonzero(leaf == n)
                    for k, at in product(range(0, len(of_leaf), 256), range(0, len(near[n]), 64)):
                        rows, js = of_leaf[k:k + 256], near[n][at:at + 64]
                        gap = np.maximum(0.0, np.maximum(lo[js][None] - x[rows][:, None], x[rows][:, None] - hi[js][None]))
                        r, j = np.nonzero((gap * gap).sum(axis=2) <= reach2)
                        r, j = rows[r], js[j]
                        times = chop[j]
                        take.append(np.repeat(r, times))
                        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        other.append(np.repeat(start[j], times) + within)
                if not take:
                    continue
                take, other = np.concatenate(take), np.concatenate(other)
                keep = np.ones(len(take), bool)
                if others:
                    keep &= own[take] != other
                if wanted is not None:
                    keep &= batch.column("open").to_numpy(zero_copy_only=False)[take] | wanted[other]
                take, other = take[keep], other[keep]
                for at in range(0, len(take), 16384):
                    t, o = take[at:at + 16384], other[at:at + 16384]
                    mine = own[t]
                    part = batch.take(pa.array(t))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(mine, o)), pa.array(np.maximum(mine, o)), pa.array(mine), *part.columns],
                        ["p", "q", "b", *names])

        return points.mapInArrow(run, f"p long, q long, b long, {kinds(points)}")

    def by_group(self, points: DataFrame, find: Callable, schema: str, others: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
        """The batches ``find(left, right)`` yields for every group: the rows of its two blocks as ``Rows`` in the
        order of ``idx`` (the same twice for a block with itself)."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches)).combine_chunks()
            b = t.column("b").to_numpy()
            p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
            left = Rows.of(t.filter(pa.array(b == p)), d)
            right = left if p == q else Rows.of(t.filter(pa.array(b == q)), d)
            yield from find(left, right)

        return self.deal(points, others, wanted).groupBy("p", "q").applyInArrow(run, schema)

    def by_block(self, points: DataFrame, find: Callable, schema: str) -> DataFrame:
        """The batches ``find(rows)`` yields for every block on its own."""
        d = self.d
        start = np.concatenate([[0], np.cumsum(self.chop)])[:-1]
        at = [F.element_at(F.lit([int(v) for v in a]), F.col("leaf") + 1) for a in (start, self.chop)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from find(Rows.of(pa.Table.from_batches(list(batches)).combine_chunks(), d))

        return points.withColumn("b", at[0] + F.pmod("idx", at[1])).groupBy("b").applyInArrow(run, schema)


def kinds(points: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)


@dataclass(frozen=True)
class Rows:
    """Rows of a block in the order of ``idx``."""
    table: pa.Table
    idx: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(table: pa.Table, d: int) -> Rows:
        table = table.sort_by("idx")
        return Rows(table, table.column("idx").to_numpy(), vectors(table.column("x").combine_chunks(), d))

    def __len__(self) -> int:
        return len(self.idx)

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def vectors(column, d: int) -> np.ndarray:
    """A binary column of ``d`` doubles each as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.empty((0, d))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.float64).reshape(-1, d)


def distances2(x: np.ndarray, y: np.ndarray, radii) -> np.ndarray:
    """Squared distances by one product; those so close to a squared radius that rounding could decide are
    summed term by term."""
    if not len(x) or not len(y):
        return np.empty((len(x), len(y)))
    centre = x.mean(axis=0)
    a, b = x - centre, y - centre
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d2 = np.maximum(na[:, None] + nb[None, :] - 2 * (a @ b.T), 0.0)
    slack = 1e-12 * (na.max() + nb.max()) * x.shape[1]
    for r in radii:
        i, j = np.nonzero(np.abs(d2 - r * r) <= slack)
        for at in range(0, len(i), 65536):
            k, m = i[at:at + 65536], j[at:at + 65536]
            terms = x[k] - y[m]
            total = np.zeros(len(k))
            for c in range(terms.shape[1]):  # in the order of the coordinates, as SQL adds them
                total += terms[:, c] * terms[:, c]
            d2[k, m] = total
    return d2


def _store_leaves(points: DataFrame, tree: Tree) -> DataFrame:
    kind = "idx long, w long, x binary, leaf int"

    def run(batches):
        for b in batches:
            lists = b.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 1))
            data = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("idx"), b.column("w"), data, pa.array(tree.leaf_of(x), pa.int32())],
                                             ["idx", "w", "x", "leaf"])

    return points.select("idx", "w", "x").mapInArrow(run, kind)


def _leaf_boxes(points: DataFrame, d: int, leaves: int):
    """Exact box, rows and weight of every leaf: partial per task, combined on Spark."""
    def run(batches):
        lo, hi = np.full((leaves, d), np.inf), np.full((leaves, d), -np.inf)
        rows, weight = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for b in batches:
            leaf = b.column("leaf").to_numpy()
            x = vectors(b.column("x"), d)
            order = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0]) if len(order) else []
            for i, j in zip(edges, [*edges[1:], len(order)], strict=True):
                n, mine = leaf[order[i]], order[i:j]
                lo[n], hi[n] = np.minimum(lo[n], x[mine].min(axis=0)), np.maximum(hi[n], x[mine].max(axis=0))
                rows[n] += len(mine)
                weight[n] += b.column("w").to_numpy()[mine].sum()
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({
            "leaf": pa.array(np.repeat(some, d), pa.int32()), "i": pa.array(np.tile(np.arange(d), len(some)), pa.int32()),
            "lo": pa.array(lo[some].ravel()), "hi": pa.array(hi[some].ravel()),
            "rows": pa.array(np.repeat(rows[some], d)), "weight": pa.array(np.repeat(weight[some], d))})

    t = (points.select("w", "x", "leaf").mapInArrow(run, "leaf int, i int, lo double, hi double, rows long, weight long")
         .groupBy("leaf", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"),
                                   F.sum("weight").alias("weight")).toArrow())  # leaves x d rows
    lo, hi = np.full((leaves, d), np.inf), np.full((leaves, d), -np.inf)
    rows, weight = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
    at, i = t.column("leaf").to_numpy(), t.column("i").to_numpy()
    lo[at, i], hi[at, i] = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    rows[at], weight[at] = t.column("rows").to_numpy(), t.column("weight").to_numpy()
    return lo, hi, rows, weight


def _walk(tree: Tree, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, radii):
    """Leaf pairs to compare (a <= b) and node pairs settled in bulk."""
    r2 = np.array([r * r for r in radii])
    slack = 1e-9
    nodes = len(tree.left)
    nlo, nhi, some = np.empty((nodes, lo.shape[1])), np.empty((nodes, lo.shape[1])), np.zeros(nodes, bool)
    for k in range(nodes - 1, -1, -1):  # children come after their parent
        if tree.left[k] < 0:
            n = tree.first[k]
            nlo[k], nhi[k], some[k] = lo[n], hi[n], rows[n] > 0
        else:
            two = [tree.left[k], tree.right[k]]
            nlo[k], nhi[k], some[k] = nlo[two].min(axis=0), nhi[two].max(axis=0), some[two].any()
    a, b = np.array([0]), np.array([0])
    compare, bulk = [], []
    while len(a):
        keep = some[a] & some[b]
        a, b = a[keep], b[keep]
        if not len(a):
            break
        near, far = (np.concatenate(x) for x in zip(*[_gaps(nlo[a[i:i + 4096]], nhi[a[i:i + 4096]], nlo[b[i:i + 4096]], nhi[b[i:i + 4096]])
                                                      for i in range(0, len(a), 4096)], strict=True))
        beyond = near[:, None] > r2 * (1 + slack)
        inside = far[:, None] <= r2 * (1 - slack)
        settled = (beyond | inside).all(axis=1)
        for x, y, k in zip(a[settled], b[settled], inside[settled], strict=True):
            if k.any():
                bulk.append(((int(tree.first[x]), int(tree.last[x])), (int(tree.first[y]), int(tree.last[y])), tuple(k.tolist())))
        a, b = a[~settled], b[~settled]
        leaf = (tree.left[a] < 0) & (tree.left[b] < 0)
        compare.append(np.stack([tree.first[a[leaf]], tree.first[b[leaf]]], axis=1))
        a, b = a[~leaf], b[~leaf]
        kids = lambda k: np.where(tree.left[k] < 0, k, tree.left[k])
        other = lambda k: np.where(tree.left[k] < 0, -1, tree.right[k])
        x = np.concatenate([kids(a), kids(a), other(a), other(a)])
        y = np.concatenate([kids(b), other(b), kids(b), other(b)])
        same = np.concatenate([a == b] * 4)
        good = (x >= 0) & (y >= 0) & (~same | (x <= y))
        a, b = x[good], y[good]
    return (np.concatenate(compare) if compare else np.empty((0, 2), int)), tuple(bulk)


def _copies(tree: Tree, sample: np.ndarray, radii, opened: bool) -> float:
    """Leaves that a leaf is compared with, by the boxes of a sample."""
    leaf, leaves = tree.leaf_of(sample), int(tree.last[0])
    lo, hi = np.full((leaves, sample.shape[1]), np.inf), np.full((leaves, sample.shape[1]), -np.inf)
    np.minimum.at(lo, leaf, sample)
    np.maximum.at(hi, leaf, sample)
    pairs, bulk = _walk(tree, lo, hi, np.bincount(leaf, minlength=leaves), radii)
    settled = sum((a1 - a0) * (b1 - b0) for (a0, a1), (b0, b1), _ in bulk) if opened else 0
    return 2.0 * (len(pairs) + settled) / leaves


def blocks(points: DataFrame, n: int, d: int, radii, store: Callable[[DataFrame], DataFrame], block: int | None = None, opened: bool = False) -> Blocks:
    """Partitions ``points`` (``idx`` unique from 0, ``w`` weight, ``x`` array of ``d`` finite doubles; ``n`` rows)
    for the given radii.  ``store`` writes a table to the shared folder and reads it again.  ``opened``: what is
    settled in bulk will be compared, too."""
    block = block or BLOCK
    leaves = int(max(1, min(-(-n // block), MAX_LEAVES, MAX_NUMBERS // max(d, 1))))
    wanted = min(SAMPLE_PER_LEAF * leaves, max(1000, 8_000_000 // d))
    # idx numbers the points in order of their ids, so a hash of it samples evenly and alike on every layout
    some = points.where(F.pmod(F.xxhash64("idx"), F.lit(max(1, n // wanted))) == 0).select("x").limit(2 * wanted).toArrow()
    sample = some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if some.num_rows else np.zeros((1, d))
    tree = fit_tree(sample, leaves)
    most = max(block, BLOCK_BYTES // (8 * max(d, 1)))
    copies = _copies(tree, sample, radii, opened)
    if copies > COPIES:
        block = min(int(-(-block * copies // COPIES)), most)
        tree = fit_tree(sample, max(1, min(-(-n // block), leaves)))
    leaves = int(tree.last[0])
    stored = store(_store_leaves(points, tree))
    lo, hi, rows, weight = _leaf_boxes(stored, d, leaves)
    pairs, bulk = _walk(tree, lo, hi, rows, radii)
    both = np.concatenate([pairs, pairs[pairs[:, 0] != pairs[:, 1]][:, ::-1]])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    near = tuple(np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, leaves)))) if leaves > 1 else (both[:, 1],)
    chop = np.maximum(-(-rows // block), 1)
    at_most = int(sum(int(rows[i]) * int(rows[j]) if i != j else int(rows[i]) * (int(rows[i]) - 1) // 2 for i, j in pairs))
    return Blocks(stored, d, tuple(radii), lo, hi, weight, chop, near, bulk, at_most)
