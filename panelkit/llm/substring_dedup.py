"""Exact substring deduplication: bytes under a 50-byte string that a smaller document also holds.

The order of all suffixes is built column by column (``collection_bwt``), one symbol of every string a round,
with the transform in an external file.  Only the first 50 columns matter here, and a
single order over 100 TB cannot be one task, so the collection is dealt out first:

1. Texts are packed into chunks of about ``CHUNK`` bytes, stored compressed.
2. Every window of 50 bytes has a content-defined anchor (``anchors``); equal windows share its hash.  Each
   chunk sends its distinct anchor hashes (40 bits, the rest is in the address) to the hash's bucket, which
   answers which of them occur in more than one document.  Wrong matches only cost work.
3. The segments under such anchors go, distinct within their chunk and with the smallest owner, to the
   anchor's bucket.  There equal strings are combined once more, and all distinct strings, dealt on by anchor,
   form the bucket's ``COLLECTIONS`` collections (what one holds stays in a core's cache); the order of each
   groups equal windows (runs of common prefixes of 50 or more), and each group gets its smallest owner.
4. The answers go back to the chunks, which cut the covered bytes and return the cut ranges and what is left.

A bucket holds a hash-dealt share of the distinct strings and its size does not grow with the corpus (the
number of buckets does); copies are combined before every shuffle.  An anchor in more than ``HOT`` chunks
(boilerplate with ever different surroundings) is dealt anew: each of its windows goes to a bucket by the
hash of its own 50 bytes.

Defined cases: a null or empty text has no bytes; a row with a null id loses nothing and owns nothing; rows
that share an id lose nothing to each other (owners must be smaller); other columns are ignored; an empty
table gives an empty result; texts are taken whole (a document lies in one chunk, however long).
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.anchors import GRAM, WINDOW, segments
from panelkit.llm.collection_bwt import first_owner
from panelkit.llm.common import small_batches, stage

CHUNK = 2 << 20
PRINT_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20  # text bytes per bucket of anchors and of strings
HOT = 4096
_LOW = np.uint64((1 << 40) - 1)
COLLECTIONS = 8  # of a bucket; the number of a string's collection stands above its windows in one byte
assert WINDOW - GRAM + 1 < 32
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RESULT = "id long, n_bytes long, spans array<struct<start: long, `end`: long>>, kept binary"


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


@contextlib.contextmanager
def _few_rows(spark: SparkSession, rows: int = 16):
    """Chunks are large rows: few of them in an Arrow batch while the steps here run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows to chunk rows."""
    names = ["chunk", "n_bytes", "ids", "ends", "data"]
    part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def row():
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        known = np.array([i is not None for i in ids])
        values = np.array([0 if i is None else i for i in ids], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number], pa.int64()), pa.array([size], pa.int64()),
             pa.array([_pack(values.tobytes() + known.tobytes())]), pa.array([_pack(ends.tobytes())]), pa.array([_pack(b"".join(texts))])],
            names=names)

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            t = (t or "").encode()
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= CHUNK:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield row()


class Chunk:
    """A chunk's documents and segments."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes):
        self.ends = np.frombuffer(_unpack(ends), np.int64)
        raw, n = _unpack(ids), len(self.ends)
        self.ids, self.known = np.frombuffer(raw[:8 * n], np.int64), np.frombuffer(raw[8 * n:], bool)
        self.data = np.frombuffer(_unpack(data), np.uint8)
        start, n, h, doc = segments(self.data, self.ends)
        keep = self.known[doc]
        self.start, self.n, self.hash, self.doc = start[keep], n[keep], h[keep], doc[keep]

    def _distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's distinct anchor hashes (sorted), whether several of its documents have them, and the
        number of every segment's hash among them."""
        order = np.argsort(self.hash)
        h, ids = self.hash[order], self.ids[self.doc[order]]
        new = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
        first = np.flatnonzero(new)
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        if not len(first):
            return h, np.empty(0, bool), number
        return h[first], np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first), number

    def prints(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per bucket: the chunk's distinct anchor hashes (sorted), and whether several of its documents have them."""
        distinct, several, _ = self._distinct()
        for bucket, part in _dealt(_print_bucket(distinct, buckets), buckets):
            yield bucket, distinct[part], several[part]

    def strings(self, answers: list, buckets: int):
        """The chunk's occurrences of strings under repeated anchors, after the buckets' answers.  Returns
        per occurrence first byte, windows, document and number of its distinct string; per distinct string
        one of its occurrences, its smallest owner, its bucket and its collection there."""
        empty = np.empty(0, np.int64)
        if not answers:
            return (empty,) * 8
        distinct, _, of = self._distinct()
        print_buckets = answers[0]["buckets"]
        sent = dict(_dealt(_print_bucket(distinct, print_buckets), print_buckets))
        level = np.zeros(len(distinct), np.uint8)
        for a in answers:
            part = sent[a["bucket"]]
            level[part] = np.unpackbits(np.frombuffer(a["repeated"], np.uint8), count=len(part)) + np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=len(part))
        level = level[of]
        one, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        if not len(one) + len(hot):
            return (empty,) * 8
        start, n, doc, key = self.start[one], self.n[one], self.doc[one], self.hash[one]
        if len(hot):  # every window by itself, dealt by its own hash
            times = self.n[hot]
            s = np.repeat(self.start[hot] - np.cumsum(times) + times, times) + np.arange(times.sum())
            start, n = np.concatenate([start, s]), np.concatenate([n, np.ones(len(s), np.int64)])
            doc = np.concatenate([doc, np.repeat(self.doc[hot], times)])
            key = np.concatenate([key, self._content_hashes(s, n[len(one):])])
        order, first = self._equal(start, n)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        owner = np.minimum.reduceat(self.ids[doc[order]], heads)
        sample = order[heads]
        key = key[sample]
        return (start, n, doc, number, sample, owner, ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64),
                (key >> np.uint64(8)).astype(np.uint8) % COLLECTIONS)

    def _words(self, start: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """Words of eight bytes that together cover the strings: whole ones from the first byte over a window,
        then from the last byte back."""
        words = np.ndarray(len(self.data) - 7, np.dtype("<u8"), self.data, strides=(1,))
        for k in range(0, WINDOW - 7, 8):
            yield words[start + k]
        stop = start + n + WINDOW - 1
        for k in range(8, WINDOW - GRAM + WINDOW % 8 + 8, 8):
            yield words[stop - k]

    def _content_hashes(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """64-bit hashes of strings."""
        h = n.astype(np.uint64)
        for w in self._words(start, n):
            h ^= w
            h *= _MIX
            h ^= h >> np.uint64(32)
        return h * _MIX

    def _equal(self, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order in which equal strings follow each other, and where it goes on with another string.  Only
        equal bytes count as equal; strings that a clash of hashes stood between stay apart, which costs work only."""
        order = np.argsort(self._content_hashes(start, n), kind="stable")  # the same wherever it is computed again
        start, n = start[order], n[order]
        same = n[1:] == n[:-1]
        for w in self._words(start, n):
            same &= w[1:] == w[:-1]
        return order, np.concatenate([[True], ~same])

    def bytes_of(self, start: np.ndarray, n: np.ndarray) -> bytes:
        length = n + WINDOW - 1
        at = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        return self.data[at].tobytes()


def _print_bucket(distinct: np.ndarray, buckets: int) -> np.ndarray:
    return (distinct >> np.uint64(40)).astype(np.int64) % buckets


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per bucket: which rows are dealt to it, ascending."""
    by = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")  # 16 bits are sorted by counting
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        yield int(bucket[part[0]]), part


def _prints(buckets: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = list(Chunk(r["ids"], r["ends"], r["data"]).prints(buckets))
                prints = [(h & _LOW).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for _, h, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([r["chunk"]] * len(rows), pa.int64()),
                     pa.array(prints, pa.binary()), pa.array([np.packbits(x[2]).tobytes() for x in rows], pa.binary())],
                    names=["bucket", "chunk", "prints", "several"])
    return run


def _answers(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        """Which hashes of the bucket are in several chunks or documents, and which in very many chunks."""
        rows = t.to_pylist()
        sizes = [len(r["prints"]) // 5 for r in rows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(r["prints"] for r in rows), np.uint8).reshape(-1, 5)
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)])
        _, of, times = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        repeated = (times > 1) | (np.bincount(of, several) > 0)
        out = {"chunk": [], "bucket": [], "buckets": [], "repeated": [], "hot": []}
        ends = np.cumsum(sizes)
        for r, n, e in zip(rows, sizes, ends, strict=True):
            mine = of[e - n:e]
            if repeated[mine].any():
                out["chunk"].append(r["chunk"])
                out["bucket"].append(r["bucket"])
                out["buckets"].append(buckets)
                out["repeated"].append(np.packbits(repeated[mine]).tobytes())
                out["hot"].append(np.packbits(repeated[mine] & (times[mine] > HOT)).tobytes())
        return pa.table({k: pa.array(v, {"chunk": pa.int64(), "bucket": pa.int32(), "buckets": pa.int32()}.get(k, pa.binary())) for k, v in out.items()})
    return run


def _send_strings(buckets: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["data"])
                start, n, _, _, sample, owner, bucket, collection = c.strings(r["answers"] or [], buckets)
                start, n = start[sample], n[sample]
                windows = n.astype(np.uint8) | collection << np.uint8(5)
                dealt = list(_dealt(bucket, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in dealt], pa.int32()), pa.array([r["chunk"]] * len(dealt), pa.int64()),
                     pa.array([_pack(c.bytes_of(start[p], n[p])) for _, p in dealt], pa.binary()),
                     pa.array([windows[p].tobytes() for _, p in dealt], pa.binary()),
                     pa.array([_pack(owner[p].tobytes()) for _, p in dealt], pa.binary())],
                    names=["bucket", "chunk", "text", "windows", "owners"])
    return run


def _owners_of_windows(t: pa.Table) -> pa.Table:
    """Per row (a chunk's strings in this bucket): the smallest owner of each of their windows."""
    numbers: list[dict[bytes, int]] = [{} for _ in range(COLLECTIONS)]
    rows, mine, owners = t.select(["chunk", "bucket", "text", "windows", "owners"]).to_pylist(), [], []
    windows = np.frombuffer(b"".join(r["windows"] for r in rows), np.uint8)
    collection, size = windows >> np.uint8(5), (windows & np.uint8(31)).astype(np.int64)
    i = 0
    for r in rows:
        text, k = _unpack(r["text"]), len(r["windows"])
        stops = np.cumsum(size[i:i + k] + WINDOW - 1).tolist()
        for begin, stop, number in zip([0, *stops[:-1]], stops, map(numbers.__getitem__, collection[i:i + k].tolist()), strict=True):
            mine.append(number.setdefault(text[begin:stop], len(number)))
        owners.append(np.frombuffer(_unpack(r["owners"]), np.int64))
        i += k
    mine, owners = np.array(mine, np.int64), np.concatenate(owners)
    answer = np.empty(int(size.sum()), np.int64)
    place = np.cumsum(size) - size
    for k, number in enumerate(numbers):
        here = np.flatnonzero(collection == k)
        if not len(here):
            continue
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, mine[here], owners[here])
        strings = list(number)
        found = first_owner(strings, least, WINDOW)
        flat, n = np.concatenate(found), size[here]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        answer[np.repeat(place[here], n) + step] = flat[np.repeat((np.cumsum(sizes) - sizes)[mine[here]], n) + step]
    ends = np.cumsum([0, *(len(r["windows"]) for r in rows)])
    bounds = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                     "owners": pa.array([_pack(answer[a:b].tobytes()) for a, b in itertools.pairwise(bounds)], pa.binary())})


def _apply(buckets: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["data"])
                covered = np.zeros(len(c.data) + 1, np.int32)
                start, n, doc, number, sample, _, bucket, _ = c.strings(r["answers"] or [], buckets)
                if len(sample):
                    back = {a["bucket"]: np.frombuffer(_unpack(a["owners"]), np.int64) for a in r["found"]}
                    dealt = list(_dealt(bucket, buckets))
                    by, flat = np.concatenate([p for _, p in dealt]), np.concatenate([back[k] for k, _ in dealt])
                    size = n[sample][by]
                    begin = np.empty(len(sample), np.int64)
                    begin[by] = np.cumsum(size) - size
                    total = np.cumsum(n) - n
                    step = np.arange(int(n.sum())) - np.repeat(total, n)
                    owner = flat[np.repeat(begin[number], n) + step]
                    gone = owner < np.repeat(c.ids[doc], n)
                    where = (np.repeat(start, n) + step)[gone]
                    np.add.at(covered, where, np.int32(1))
                    np.add.at(covered, where + WINDOW, np.int32(-1))
                mask = np.cumsum(covered[:-1]) > 0
                edges, kept, begin = [], [], 0
                for end in c.ends.tolist():
                    m, d = mask[begin:end], c.data[begin:end]
                    edge = np.flatnonzero(np.diff(m, prepend=False, append=False))  # where ranges start and end, in turn
                    edges.append(edge)
                    kept.append((d[~m] if len(edge) else d).tobytes())
                    begin = end
                flat = np.concatenate(edges).astype(np.int64)
                offsets = np.cumsum([0, *(len(x) // 2 for x in edges)], dtype=np.int32)
                spans = pa.StructArray.from_arrays([pa.array(flat[::2]), pa.array(flat[1::2])], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64(), mask=~c.known), pa.array(np.diff(c.ends, prepend=0), pa.int64()),
                     pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "spans", "kept"])
    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` (the removed byte ranges, ascending, ends exclusive) and
    ``kept`` (the bytes left; a cut may fall inside a character).  ``n_removed``, ``n_spans`` and ``kept_sha256``
    are expressions on these, computed only where they are read."""
    spark = docs.sparkSession
    small_batches(spark)
    chunks = stage(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        pack_chunks, "chunk long, n_bytes long, ids binary, ends binary, data binary"), "chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    print_buckets, buckets = max(8, -(-total // PRINT_BYTES)), max(8, -(-total // BUCKET_BYTES))
    with _few_rows(spark):
        answers = stage(chunks.mapInArrow(_prints(print_buckets), "bucket int, chunk long, prints binary, several binary")
                        .groupBy("bucket").applyInArrow(_answers(print_buckets), "chunk long, bucket int, buckets int, repeated binary, hot binary"), "answers")
        by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "buckets", "repeated", "hot")).alias("answers"))
        asked = chunks.join(by_chunk, "chunk", "left")
        found = stage(asked.where("answers IS NOT NULL")
                      .mapInArrow(_send_strings(buckets), "bucket int, chunk long, text binary, windows binary, owners binary")
                      .groupBy("bucket").applyInArrow(_owners_of_windows, "chunk long, bucket int, owners binary"), "owners")
        back = found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "owners")).alias("found"))
        out = stage(asked.join(back, "chunk", "left").mapInArrow(_apply(buckets), _RESULT), "substrings")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return (out.withColumn("n_removed", removed).withColumn("n_spans", F.size("spans").cast("long"))
            .withColumn("kept_sha256", F.sha2("kept", 256)).withColumnRenamed("id", id_col))
