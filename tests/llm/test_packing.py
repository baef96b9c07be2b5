"""Sequence packing: tokens against the public library, plans against bounds and small optima, odd inputs."""

import os
import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import packing
from panelkit.llm.queries_vectors import op12_sequence_packing
from panelkit.llm.tokens import encoder, vocabulary_path
from tests.conftest import SF_SMALL

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def library_ids(text):
    return np.array(encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_library():
    rng = random.Random(4)
    letters = [*"abcXYZ09 's'll'T \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 éÉßſΣσςİıŉ日本語☃́̇éﬁ²½Ⅷ٣", "<|endoftext|>", "<|startoftext|>",
               "\U0001F600", "ǅ", "_", "--", "'s", "'LL"]
    ids = encoder(vocabulary_path()).ids
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert ids(text) == library_ids(text), repr(text)


def test_long_texts_are_cut_at_white_space_only(monkeypatch):
    from panelkit.llm import tokens
    text = "alpha beta's gamma\tdelta " * 50 + "x" * 500 + " end"
    whole = library_ids(text)
    monkeypatch.setattr(tokens, "SLICE", 7)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    assert tokens.Encoder(vocabulary_path()).ids(text) == whole


def unpack(plan, histogram, capacity):
    """All pieces of the plan by sequence; checks gapless offsets and the capacity."""
    found = {}
    for n, c in histogram.items():
        at, offset = plan.place(np.full(c, n), np.arange(c))
        for s, o in zip(at.tolist(), offset.tolist()):
            found.setdefault(s, []).append((o, n))
    for parts in found.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    assert sorted(found) == list(range(plan.sequences))
    return found


def fewest(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[k] -= lengths[i]
            go(i + 1, rooms)
            rooms[k] += lengths[i]
        go(i + 1, [*rooms, capacity - lengths[i]])
    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plan_of_few_pieces_is_near_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(11)]
    histogram = {n: lengths.count(n) for n in lengths}
    plan = packing.make_plan(histogram, 100)
    unpack(plan, histogram, 100)
    assert plan.sequences <= fewest(lengths, 100) + 1


@pytest.mark.parametrize("capacity,many", list(product((64, 2048), (1, 50))))
def test_plan_of_many_pieces_is_near_the_bound(capacity, many):
    rng = np.random.default_rng(capacity + many)
    lengths = np.clip(rng.lognormal(np.log(capacity / 4), 0.8, 400).astype(int), 1, capacity)
    histogram = {int(n): int(c) * many for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.make_plan(histogram, capacity)
    unpack(plan, histogram, capacity)
    full = histogram.get(capacity, 0)
    bound = full + -(-sum(n * c for n, c in histogram.items() if n < capacity) // capacity)
    assert plan.sequences <= bound * 1.02 + 1


def test_plan_of_one_length_and_of_nothing():
    for histogram in ({}, {1: 5000}, {2048: 3}, {1025: 7}, {1024: 7}, {700: 300_000, 1: 1}):
        plan = packing.make_plan(histogram)
        got = unpack(plan, histogram, 2048)
        (n, c), = [max(histogram.items(), key=lambda x: x[1])] if histogram else [(1, 0)]
        assert len(got) == -(-c // (2048 // n))


def test_query_round_trip(spark):
    rows = op12_sequence_packing(spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    total, by_sequence = 0, {}
    for doc, text in texts.items():
        data = library_ids(text) + packing.END
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(data) // 8192)))
        for r in mine:
            part = data[4 * r["start"]:4 * (r["start"] + r["length"])]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(part) // 4, zlib.crc32(part))
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(r["length"] for r in mine) * 4 == len(data)
        total += len(data) // 4
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1


def test_odd_rows_and_sequences(spark):
    schema = "doc_id long, text string, id string, number string, length string, sequence_id string, offset string, piece string"
    data = [(i, t, *["x"] * 6) for i, t in enumerate([None, "", " \n ", "a", "same words here", "same words here", "word " * 9000])]
    docs = spark.createDataFrame([*data, (None, "no id", *["x"] * 6), data[3]], schema).repartition(3)
    packed = packing.pack(docs, with_ids=True)
    rows = packed.collect()
    assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 3 for r in rows) == 2
    assert [r["length"] for r in rows if r["doc_id"] in (0, 1, 2)] == [1, 1, 1]
    assert sorted(r["length"] for r in rows if r["doc_id"] == 6) == [9001 - 4 * 2048, *[2048] * 4]
    whole = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in rows)
    for s in whole:
        assert len(s["ids"]) == 4 * s["n_tokens"] <= 8192
        for p in s["parts"]:
            text = next(t for i, t in [*((r[0], r[1]) for r in data), (None, "no id")] if i == p["doc_id"])
            start = 8192 * p["piece"]
            assert bytes(s["ids"][4 * p["offset"]:4 * (p["offset"] + p["length"])]) == (library_ids(text) + packing.END)[start:start + 4 * p["length"]]
    empty = packing.pack(docs.where(F.lit(False)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_other_ids_and_names(spark):
    docs = spark.createDataFrame([("k1", "one two"), ("k2", None)], "key string, body string")
    assert {r["key"]: r["length"] for r in packing.pack(docs, "key", "body").collect()} == {"k1": 3, "k2": 1}
