"""Hard negatives by exact Four-Russians scores.

Every row is a candidate, rows whose id is divisible by ``every`` are anchors.  Components become whole numbers
floor(scale * x); a score is the integer inner product.

1. A row's components are stored as bit planes (two's complement): one byte holds one bit of eight components.
   Exact repeats of a row are one row from here on.
2. For a batch of anchors and each group of eight components a table holds the sum of every subset, all anchors
   side by side.  A candidate's byte picks its subset sum; the sums of a plane are added, and planes are shifted
   and added to full exact scores, whole candidate blocks at a time.
3. Candidates are dealt into blocks by a hash of the row, so no label, id or common vector makes a block large; a
   block is bounded in bytes.  Each block meets the stream of all anchors: a task sorts its rows (block first,
   then anchors), keeps the block, and returns the best few per anchor.  Nothing passes through the driver, and
   no pair becomes a row.
4. First pass: the first ``positives`` other rows of the anchor's label.  Second pass, with their scores as
   bounds: the first ``negatives`` rows of other labels whose score is within ``low`` to ``high`` per cent of the
   positive's.  Per anchor the blocks' best are merged by a window that holds a few rows a block.

Order: higher score, then smaller id.  Other rows are rows of another id.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; shorter
vectors (also empty ones) count as filled up with zeros; whole numbers beyond +-2**24 count as +-2**24; an exact
repeat counts once; rows that share an id but differ are rows of their own, and as anchors each gets its results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import map_columns, small_batches, stage
from panelkit.operators.ranking import with_global_index

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
LIMIT = 2**24
BLOCK_BYTES, CHUNK = 32_000_000, 1024


def whole_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``x`` (whole numbers) of the rows that take part."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    top = F.lit(float(LIMIT))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
            .select("id", "label", F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, top), -top)).cast("int")).alias("x")))


def bit_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """n x d whole numbers -> n x planes x ceil(d / 8) bytes; bit j of a byte is component 8 g + j."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def from_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers (filled up to a multiple of eight components)."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(packed.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("npd,p->nd", bits, weights)


def _holds(bound: int):
    return np.int16 if bound < 2**15 else np.int32 if bound < 2**31 else np.int64


def subset_sums(x: np.ndarray, planes: int) -> np.ndarray:
    """Table (group, byte, anchor) of the sums of the components whose bit is set."""
    n, d = x.shape
    table = np.zeros((d // 8, 256, n), _holds(d << (planes - 1)))  # also holds a whole plane's sum
    for g in range(d // 8):
        for j in range(8):
            table[g, 1 << j:2 << j] = table[g, :1 << j] + x[:, 8 * g + j].astype(table.dtype)
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products, candidates x anchors, by lookups: shift and add over the planes."""
    n, planes, groups = packed.shape
    total = None
    part, sums = np.empty((n, table.shape[2]), table.dtype), np.empty((n, table.shape[2]), table.dtype)
    kind = _holds((8 * groups) << (2 * planes - 2))
    for p in range(planes - 1, -1, -1):
        sums.fill(0)
        for g in range(groups):
            np.take(table[g], packed[:, p, g], axis=0, out=part, mode="clip")
            sums += part
        if total is None:
            total = -sums.astype(kind)
        else:
            total <<= 1
            total += sums
    return total


class _Best:
    """The first ``k`` (score, candidate) of each of ``n`` lists; candidates come in rising order."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.n = k, n
        self.floor = floor  # only higher scores can enter
        self.list = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.at = np.empty(0, np.int64)

    def add(self, which: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        if not len(which):
            return
        which, score, at = (np.concatenate(x) for x in ((self.list, which), (self.score, score), (self.at, at)))
        order = np.lexsort((at, -score, which))
        which, score, at = which[order], score[order], at[order]
        first = np.searchsorted(which, which, "left")
        keep = np.arange(len(which)) - first < self.k
        self.list, self.score, self.at = which[keep], score[keep], at[keep]
        held = np.bincount(self.list, minlength=self.n)
        ends = np.searchsorted(self.list, np.flatnonzero(held == self.k), "right") - 1
        self.floor[self.list[ends]] = np.maximum(self.floor[self.list[ends]], self.score[ends])


class _Block:
    """Candidates of one block, in order of their ids."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.parts = shape, []

    def add(self, b: pa.RecordBatch) -> None:
        self.parts.append((b.column("id").to_numpy(), b.column("label").to_numpy(), _packed(b, self.shape)))

    def chunks(self):
        if len(self.parts) > 1:
            self.parts = [tuple(map(np.concatenate, zip(*self.parts, strict=True)))]
        ids, labels, packed = self.parts[0]
        at, size = 0, 64
        while at < len(ids):  # small chunks first: they raise the floors
            yield at, ids[at:at + size], labels[at:at + size], packed[at:at + size]
            at, size = at + size, min(2 * size, CHUNK)

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.parts[0][0][at]


def _packed(b: pa.RecordBatch, shape: tuple[int, int]) -> np.ndarray:
    data = b.column("planes")
    start, end = data.offset * shape[0] * shape[1], (data.offset + len(data)) * shape[0] * shape[1]
    return np.frombuffer(data.buffers()[2], np.uint8)[start:end].reshape(-1, *shape)


def _meet(shape: tuple[int, int], find):
    """Runs ``find(block, anchors, subset sums)`` for each block and batch of anchors of a task's sorted rows."""
    def run(batches):
        at, block = None, None
        for b in batches:
            key = b.column("q").to_numpy() * 2 + b.column("side").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                q, side = divmod(int(key[i]), 2)
                if side == 0:
                    if q != at:
                        at, block = q, _Block(shape)
                    block.add(part)
                elif q == at:
                    yield find(block, part, subset_sums(from_planes(_packed(part, shape)), shape[0]))
    return run


def _positives(k: int):
    def find(block, anchors, table):
        ids, labels, number = (anchors.column(c).to_numpy() for c in ("id", "label", "number"))
        best = _Best(len(ids), k, np.full(len(ids), np.iinfo(np.int64).min))
        for start, other, kinds, packed in block.chunks():
            s = scores(table, packed)
            hit = (s > best.floor) & (kinds[:, None] == labels) & (other[:, None] != ids)
            at, which = np.nonzero(hit)
            best.add(which, s[at, which].astype(np.int64), at + start)
        return pa.RecordBatch.from_pydict({"number": number[best.list], "other": block.ids(best.at), "score": best.score})
    return find


def _negatives(k: int, low: int, high: int):
    def find(block, anchors, table):
        ids, labels, number = (anchors.column(c).to_numpy() for c in ("id", "label", "number"))
        found = anchors.column("positives").to_pylist()
        width = max(map(len, found))
        most, floor = (np.full((width, len(ids)), np.iinfo(np.int64).min) for _ in range(2))
        for i, mine in enumerate(found):
            for j, p in enumerate(mine):
                most[j, i], floor[j, i] = high * p["score"] // 100, -(-low * p["score"] // 100) - 1
        best = [_Best(len(ids), k, floor[j]) for j in range(width)]
        for start, _, kinds, packed in block.chunks():
            s = scores(table, packed)
            away = kinds[:, None] != labels
            for j in range(width):
                at, which = np.nonzero(away & (s <= most[j]) & (s > best[j].floor))
                best[j].add(which, s[at, which].astype(np.int64), at + start)
        out = {c: [] for c in ("number", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        for j, b in enumerate(best):
            own = [found[i][j] for i in b.list]
            for c, v in zip(out, (number[b.list], np.full(len(b.list), j), ids[b.list], [p["other"] for p in own],
                                  [p["score"] for p in own], block.ids(b.at), b.score), strict=True):
                out[c].extend(v)
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return find


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = df.sparkSession
    rows = whole_rows(df, id_col, label_col, vector_col, scale)
    sizes = rows.agg(F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", lambda c: F.greatest(c, -c - 1)))).alias("top")).first()
    d, planes = max(sizes["d"] or 1, 1), int(sizes["top"] or 0).bit_length() + 1
    groups = -(-d // 8)

    def pack(id, label, x):
        full = np.zeros((len(x), 8 * groups), np.int64)
        for i, v in enumerate(x):
            full[i, :len(v)] = v
        return {"id": id, "label": label, "planes": [p.tobytes() for p in bit_planes(full, planes)]}

    packed = stage(map_columns(rows, pack, "id long, label long, planes binary").dropDuplicates(), "bit-planes")
    n = packed.count()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-n * (planes * groups + 16) // block_bytes))
    anchors = with_global_index(packed.where(F.col("id") % every == 0), ["id", "label", "planes"], "number")
    candidates = packed.select(F.pmod(F.xxhash64("id", "label", "planes"), F.lit(blocks)).alias("q"), F.lit(0).alias("side"),
                               F.lit(None).cast("long").alias("number"), "id", "label", "planes")
    small_batches(spark)

    def meet(asking: DataFrame, find, schema: str) -> DataFrame:
        """Every block meets all of ``asking``."""
        sent = asking.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("q"), F.lit(1).alias("side"), *asking.columns)
        return (candidates.unionByName(sent, allowMissingColumns=True).repartitionByRange(blocks, "q")
                .sortWithinPartitions("q", "side", "id", "number").mapInArrow(_meet((planes, groups), find), schema))

    def first(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(score), other)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = first(meet(anchors.select("number", "id", "label", "planes"), _positives(positives),
                      "number long, other long, score long"), ["number"], "score", "other", positives)
    own = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("positives"))
    asking = stage(anchors.join(own, "number").select("number", "id", "label", "planes", "positives"), "anchors")
    found = meet(asking, _negatives(negatives, low, high),
                 "number long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return first(found, ["number", "place"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
