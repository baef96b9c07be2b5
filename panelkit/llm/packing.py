"""Packing documents into sequences by linear grouping and best fit.

A document is its token ids and one end token; one longer than a sequence is cut into full pieces, of which
only the last may be shorter.  Whole pieces are placed, as few sequences as the method finds:

1. Only the number of pieces of each length matters, so the plan is made from that histogram: at most
   ``capacity`` numbers, whatever the size of the corpus.
2. Linear grouping: pieces longer than ``capacity // SMALL`` are large.  They are ordered by length and cut into ``GROUPS``
   groups of equal size; every length is rounded up to its group's longest (groups of one length are one).
3. The fewest sequences for the rounded lengths are found over configurations (multisets that fit) by column
   generation: a revised simplex whose next configurations come from a knapsack table over the duals.
   Configurations are used a whole number of times (rounded down).
4. Actual pieces take the places of their group, longest first.  A sequence that rounding left with more
   than ``capacity // SLACK`` empty gives its shortest piece back, so that a better fitting one can follow.
5. All other pieces (small ones, what rounding down left, what was given back) are placed longest first by
   best fit: where they leave the least room, else in a new sequence.

On lengths like those of ``documents`` this is within 0.1 % of the sum of lengths over the capacity (tested).

Sequences of equal content are one entry of the plan with a count (a piece length and how often), so steps 4
and 5 also work on counts and never on single documents, and the plan has a bounded number of entries.  On
Spark, pieces are numbered within their length by a range-partitioned sort, and each finds its place in the
plan by that number.

Defined cases: a null or empty text is the end token alone; a null id is carried through; rows that repeat
or share an id are packed each; other columns are ignored; an empty table gives an empty result.  Tokens are
never dropped or repeated.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelkit.llm.common import map_columns, stage
from panelkit.llm.tokens import encoder, vocabulary_path
from panelkit.operators.ranking import with_global_index

CAPACITY, END = 2048, b"\0\0\0\0"
GROUPS, SMALL, SLACK = 100, 4, 512
ROUNDS, TOLERANCE = 400, 1e-4  # pricing rounds; a stop earlier or later changes the count, not the validity


# ---- plan ----------------------------------------------------------------------------------------
@dataclass
class Plan:
    """Places by length: ``slots[length]`` has rows (first, number, sequence, per, offset): the pieces numbered
    from ``first`` on go ``per`` to a sequence from ``sequence`` on, side by side from ``offset``."""
    sequences: int
    slots: dict[int, np.ndarray]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            rows, mine = self.slots[int(n)], length == n
            k = number[mine]
            s = rows[np.searchsorted(rows[:, 0], k, "right") - 1]
            k = k - s[:, 0]
            at[mine], offset[mine] = s[:, 2] + k // s[:, 3], s[:, 4] + k % s[:, 3] * n
        return at, offset


def _groups(histogram: dict[int, int], capacity: int) -> dict[int, list[list[int]]]:
    """Rounded length -> its [length, count], longest first."""
    large = sorted((n for n in histogram if capacity // SMALL < n < capacity), reverse=True)
    size = max(1, -(-sum(histogram[n] for n in large) // GROUPS))
    out: dict[int, list[list[int]]] = {}
    top, free = 0, 0
    for n in large:
        left = histogram[n]
        while left:
            if free == 0:
                top, free = n, size
            take = min(left, free)
            out.setdefault(top, []).append([n, take])
            left, free = left - take, free - take
    return out


def _best_fill(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per room: the most worth that fits (unbounded knapsack) and the item taken last (-1: none).
    ``sizes`` rise strictly."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        k = np.searchsorted(sizes, c, "right")
        got = worth[:k] + best[c - sizes[:k]]
        i = int(got.argmax())
        if got[i] > best[c - 1]:
            best[c], last[c] = got[i], i
        else:
            best[c], last[c] = best[c - 1], -1
    return best, last


def _filling(sizes: np.ndarray, last: np.ndarray, room: int) -> np.ndarray:
    out = np.zeros(len(sizes))
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out[last[room]] += 1
            room -= sizes[last[room]]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[float, dict[int, int]]]:
    """Configurations of ``sizes`` and how often each is used by a (nearly) optimal fractional packing."""
    s, n = np.array(sizes, np.int64), np.array(counts, float)  # sizes rise
    fits = capacity // s
    basis = np.diag(fits.astype(float))
    inverse = np.diag(1.0 / fits)
    x = n / fits
    for _ in range(ROUNDS):
        worth = np.maximum(inverse.sum(axis=0), 0.0)
        best, last = _best_fill(s, worth, capacity)
        reach = worth + best[capacity - s]
        if reach.max() <= 1 + TOLERANCE:
            break
        moved = False
        tried = set()
        for i in np.argsort(-reach)[:12]:
            if reach[i] <= 1 + TOLERANCE:
                break
            column = _filling(s, last, int(capacity - s[i]))
            column[i] += 1
            if (key := column.tobytes()) in tried or inverse.sum(axis=0) @ column <= 1 + TOLERANCE / 2:
                continue
            tried.add(key)
            d = inverse @ column
            able = d > 1e-9
            if not able.any():
                continue
            ratio = np.where(able, x / np.where(able, d, 1.0), np.inf)
            out = int(ratio.argmin())
            x = np.maximum(x - ratio[out] * d, 0.0)
            x[out] = ratio[out]
            basis[:, out] = column
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
            moved = True
        if not moved:
            break
    return [(float(x[j]), {sizes[i]: int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}) for j in range(len(x)) if x[j] > 0]


def _substitute(groups: dict[int, list[list[int]]], used: list[tuple[int, dict[int, int]]]) -> list[tuple[int, Counter]]:
    """Sequences as (how many, lengths in each): actual lengths in the places of their groups."""
    out = []
    for times, config in used:
        cuts, places = {0, times}, []
        for size, copies in config.items():
            for _ in range(copies):
                at, runs, queue = 0, [], groups[size]
                while at < times and queue:
                    take = min(times - at, queue[0][1])
                    runs.append((at, at + take, queue[0][0]))
                    at += take
                    cuts.add(at)
                    queue[0][1] -= take
                    if queue[0][1] == 0:
                        queue.pop(0)
                places.append(runs)
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:], strict=False):
            inside = Counter(n for runs in places for lo, hi, n in runs if lo <= a < hi)
            if inside:
                out.append((b - a, inside))
    return out


def _best_fit(sequences: list[tuple[int, Counter]], rest: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Adds ``rest`` (length -> count), longest first, each piece where it leaves the least room."""
    rooms: list[list[tuple[int, Counter]]] = [[] for _ in range(capacity + 1)]
    for times, inside in sequences:
        rooms[capacity - sum(n * k for n, k in inside.items())].append((times, inside))
    for n in sorted(rest, reverse=True):
        left, room = rest[n], n
        while left:
            while room < capacity and not rooms[room]:
                room += 1
            times, inside = rooms[room].pop() if rooms[room] else (-(-left // (capacity // n)), Counter())
            per = room // n  # best fit goes on with the same sequence while another fits
            full = min(times, left // per)
            if full:
                rooms[room - per * n].append((full, inside + Counter({n: per})))
                times, left = times - full, left - full * per
            if times and 0 < left < per:
                rooms[room - left * n].append((1, inside + Counter({n: left})))
                times, left = times - 1, 0
            if times and inside:
                rooms[room].append((times, inside))
    return [run for runs in rooms for run in runs]


def _reopen(sequences: list[tuple[int, Counter]], capacity: int) -> tuple[list[tuple[int, Counter]], Counter]:
    """Sequences that are not full but for ``capacity // SLACK`` give back their shortest piece; all sequences,
    and what was given back."""
    out, back = [], Counter()
    for times, inside in sequences:
        if capacity - sum(n * k for n, k in inside.items()) > capacity // SLACK:
            n = min(inside)
            back[n] += times
            inside = inside - Counter({n: 1})
        out.append((times, inside))
    return [x for x in out if x[1]], back


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for ``histogram`` (length -> number of pieces)."""
    histogram = {int(n): int(c) for n, c in histogram.items() if c}
    full = histogram.get(capacity, 0)
    groups = _groups(histogram, capacity)
    sizes = sorted(groups)
    used = []
    if sizes:
        for x, config in configurations(sizes, [sum(c for _, c in groups[n]) for n in sizes], capacity):
            if times := int(x + 1e-6):
                used.append((times, config))
    sequences = _substitute(groups, used)
    rest = Counter({n: c for n, c in histogram.items() if n <= capacity // SMALL and n < capacity})
    for queue in groups.values():
        for n, c in queue:
            rest[n] += c
    sequences, opened = _reopen(sequences, capacity)
    rest.update(opened)
    sequences = _best_fit(sequences, rest, capacity) + ([(full, Counter({capacity: 1}))] if full else [])
    numbered: Counter = Counter()
    slots: dict[int, list] = {}
    base = 0
    for times, inside in sequences:
        offset = 0
        for n, per in sorted(inside.items(), reverse=True):
            slots.setdefault(n, []).append((numbered[n], times * per, base, per, offset))
            numbered[n] += times * per
            offset += n * per
        base += times
    if numbered != Counter(histogram):
        raise AssertionError("the plan does not hold every piece once")
    return Plan(base, {n: np.array(rows, np.int64) for n, rows in slots.items()})


# ---- documents -----------------------------------------------------------------------------------
def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, on request, ``ids`` (the token ids as
    little-endian unsigned 32-bit bytes)."""
    path = vocabulary or vocabulary_path()
    names = ("id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))

    def run(id, text):
        out = {k: [] for k in names}
        encode = encoder(path).ids
        for key, t in zip(id, text, strict=True):
            data = encode(t) + END
            for i, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at:at + 4 * capacity]
                for k, v in zip(names, (key, i, at // 4, len(part) // 4, zlib.crc32(part), part)):
                    out[k].append(v)
        return out

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_columns(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                       f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ids of sequences run from 0 without gaps."""
    cut = stage(pieces(docs, id_col, text_col, capacity, vocabulary, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = make_plan(counts, capacity)
    firsts, total = {}, 0
    for n in sorted(counts):
        firsts[n], total = total, total + counts[n]
    numbered = with_global_index(cut, ["length", "id", "piece"], "number")
    names = cut.columns
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            start = np.array([firsts[int(n)] for n in length], np.int64)
            at, offset = plan.place(length, b.column("number").to_numpy() - start)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(at), pa.array(offset)], [*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: ``sequence_id``, ``n_tokens``, ``ids`` (bytes as in
    ``pieces``) and ``parts`` (offset, length, id, piece).  A sequence holds at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", id_col, "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
                    F.aggregate("p", F.lit(b""), lambda all, x: F.concat(all, x["ids"])).alias("ids"),
                    F.transform("p", lambda x: x.dropFields("ids")).alias("parts")))
