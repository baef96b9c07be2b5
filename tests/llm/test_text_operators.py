"""Text operators against brute force and on odd inputs: nulls, empty and very long texts, ties, repeated
rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import (anchors, collection_bwt, decontam, language_id, line_dedup, mixing, near_dedup, quality,
                          secret_scan, substring_dedup, token_count, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, term string, key string, n long"
LONG = "word one two three " * 20_000
TEXTS = [None, "", " \n\t\n ", "a", "Ünï çödé 日本語 ☃", LONG, "same text here " * 12, "same text here " * 12]


def rows(texts, lang="en"):
    return [(i, t, lang, None if i % 3 else "s", 1, "x", "y", "z", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*rows(TEXTS), (None, "null id " * 30, None, None, None, None, None, None, None),
                                  (7, TEXTS[7], "en", None, 1, "x", "y", "z", 7)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, col="doc_id"):
    return sorted((r[col] is None, r[col] or 0) for r in df.select(col).collect())


# ---- quality rules -------------------------------------------------------------------------------
def test_quality(odd, empty):
    got = quality.quality_verdicts(odd)
    assert ids(got) == ids(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].n_words == by[1].n_words == 0 and not by[0].kept
    assert by[5].n_words == 80_000 and by[5].n_repeat_words == 80_000 and not by[5].kept
    assert quality.quality_verdicts(empty).count() == 0
    kept = quality.keep_quality(odd)
    assert kept.schema == odd.schema and kept.count() == sum(r.kept for r in got.collect())


def test_quality_order():
    # the second rule rejects as much at a tenth of the cost; the third adds nothing after it
    assert quality.greedy_order([0b111, 0b010, 0b011, 0], [10.0, 1.0, 2.0]) == [1, 2, 0]
    assert quality.repeated_words("a b c d e f g h x a b c d e f g h".encode().split()) == 16


# ---- secrets -------------------------------------------------------------------------------------
PLAIN = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))


def test_secrets_against_re():
    rnd, scan = random.Random(5), secret_scan.scanner(secret_scan.RULES)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "x.y=z", "AKIA",
             "ABCDEF0123456789", "deadbeef" * 4, "0", "é", "\n", "ghp_" + "A1" * 18, "-", "short"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PLAIN) for m in p.finditer(text) if len(m[g]) >= n)
        assert [x for x in scan.spans(text) if x[1] in ("assign", "access", "hex")] == [(a, PLAIN[k][0], b) for a, k, b in want], text


def test_secrets_frame(spark, odd, empty):
    assert ids(secret_scan.secret_report(odd)) == ids(odd)
    assert secret_scan.secret_report(empty).count() == 0
    df = spark.createDataFrame([(1, "é token: abcdefgh1 ghp_" + "Z" * 36)], "doc_id long, text string")
    r = secret_scan.secret_report(df).first()
    assert r.n_assign == 1 and r.spans == f"assign:2:18,github:19:{19 + 40}"
    assert r.base_sha256 == hashlib.sha256(b"assign:2:18").hexdigest()


# ---- token counts --------------------------------------------------------------------------------
def test_token_counts_equal_the_tokenizer(odd, empty):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers
    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.VOCABULARY)
    plain = dict(token_count.read_vocabulary())
    tok = Tokenizer(models.Unigram([(sp.id_to_piece(i), plain.get(sp.id_to_piece(i), 0.0)) for i in range(sp.get_piece_size())], 0, True))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rnd, count = random.Random(3), token_count.Counter(plain.items()).count
    texts = ["".join(rnd.choice("aeiou  thenrs\n▁éß日☃\t.") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    for t in [*texts, " ", "  a  b ", "▁a ▁", "a" * 300, "龘龘 a"]:
        assert count(t)[1] == len(tok.encode(t, add_special_tokens=False).ids), t
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(odd).collect()}
    assert got[0] is None and got[1] == 0 and len(got) == 9 and got[5] > 80_000
    assert token_count.count_tokens(empty).count() == 0


# ---- line dedup ----------------------------------------------------------------------------------
def brute_lines(docs):
    seen, out = set(), {}
    gone = {}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone[d] = set()
        for j in range(len(filled) - 2):
            w = tuple(lines[i] for i in filled[j:j + 3])
            if w in seen:
                gone[d] |= set(filled[j:j + 3])
            seen.add(w)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone[d]), len(gone[d]))
    return out


def test_line_dedup(spark, odd, empty):
    rnd = random.Random(8)
    docs = {i: "\n".join(rnd.choice(["a", "b", "c", "", "  ", "d"]) for _ in range(rnd.randint(0, 12))) for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(docs)
    out = line_dedup.dedup_lines(odd.withColumnRenamed("n", "lines"))
    assert ids(out) == ids(odd) and out.where("doc_id = 0").first().text is None
    assert line_dedup.dedup_lines(empty).count() == 0
    clash = df.withColumn("n_lines", F.lit(-1)).withColumn("n_removed", F.lit("x")).withColumn("input_n_lines", F.lit(-2))
    out = line_dedup.dedup_lines(clash)
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == brute_lines(docs)
    assert out.where("input_input_n_lines <> -1 OR input_n_removed <> 'x' OR input_n_lines <> -2").count() == 0


# ---- near duplicates -----------------------------------------------------------------------------
def brute_near(docs, k=4, percent=80):
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {d: d for d in docs}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


@pytest.mark.parametrize("block,hubs", [(1024, 2), (7, 2), (5, 0)])
def test_near_duplicates(spark, monkeypatch, block, hubs):
    """Chains of edits, below and above the threshold; small blocks, and blocks alone without hubs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", hubs)
    rnd, docs = random.Random(11), {}
    for g in range(4):
        words = [f"w{g}x{i}" for i in range(80)]
        for _ in range(14):
            docs[len(docs)] = " ".join(words)
            words = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                words[rnd.randrange(80)] = f"n{rnd.randrange(10**9)}"
    docs |= {len(docs): None, len(docs) + 1: "", len(docs) + 2: "One two", len(docs) + 3: "one TWO", len(docs) + 4: "é é"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_near(docs)


def test_large_clusters_are_checked_in_blocks(spark, monkeypatch):
    """A shared passage puts unlinked texts and a linked group in one bucket: no pair rows after the hubs."""
    calls, plain = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "confirmed", lambda *a: calls.append(1) or plain(*a))
    common = [f"c{i}" for i in range(90)]
    docs = {i: " ".join(common + [f"u{i if i < 24 else 12 + i // 2}x{j}" for j in range(30)] + [f"v{i}"]) for i in range(36)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_near(docs) and len({c for _, c in got.values()}) == 30
    assert len(calls) <= near_dedup.HUB_ROUNDS


def test_texts_that_share_an_id_keep_all_links(spark):
    """Id 1 has texts A and B; 2 is near B, 3 near A: one component on every partitioning.  Rows that repeat are equal."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b, "x"])), (3, " ".join([*a, "y"])), (4, "all alone here today"), (2, " ".join([*b, "x"]))]
    for parts in (1, 3, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (2, text, "en"), (3, "something else entirely written here", "en"), (1, text + " x", "de"), (None, "t", None), (None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang or "") for r in out.collect()) == [(False, 1, "en"), (False, 3, "en"), (True, 0, ""), (True, 0, "")]


def test_near_duplicates_odd(odd, empty):
    got = near_dedup.near_duplicates(odd)
    assert ids(got) == ids(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert by[7].component_id == 6 and by[6].kept and not by[7].kept and by[None].kept and by[0].n_shingles == 0
    assert near_dedup.near_duplicates(empty).count() == 0


# ---- exact substrings ----------------------------------------------------------------------------
def brute_substrings(docs, k=50):
    first = {}
    for d in sorted(docs):
        t = docs[d]
        for i in range(len(t) - k + 1):
            first.setdefault(t[i:i + k], d)
    out = {}
    for d, t in docs.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if first[t[i:i + k]] < d:
                gone[i:i + k] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 0])
def test_substrings(spark, monkeypatch, hot):
    """Shared passages, near copies, low-complexity text; ``hot`` 0 deals every repeated window by itself."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
    rnd = random.Random(4)
    words = ["the", "of", "tion", "être", "日本", "a", "zzzz"]
    shared = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(5)]
    docs = {}
    for i in range(60):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(shared), "a" * rnd.choice([0, 10, 120])]
        rnd.shuffle(parts)
        docs[i * 3 % 61] = " ".join(parts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == brute_substrings({d: t.encode() for d, t in docs.items()})


def test_substrings_odd(odd, empty):
    got = substring_dedup.dedup_substrings(odd)
    assert ids(got) == ids(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].n_bytes == 0 and by[None].n_removed == 0 and by[7].n_removed == by[7].n_bytes and by[6].n_removed == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substrings_returns_spans_and_kept_bytes(spark):
    """The real outputs: byte ranges and what is left, also between neighbours in a chunk and inside characters."""
    a, b = "0123456789" * 6, "é" * 40
    docs = {1: a + "|" + b, 2: b + " own " + a, 3: a, 4: a + "tail", 5: "x" + b, 6: "", 7: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(df).collect()}
    want = brute_substrings({d: (t or "").encode() for d, t in docs.items()})
    for d, t in docs.items():
        raw, at, left = (t or "").encode(), 0, b""
        for x in got[d].spans:
            assert at <= x.start < x.end <= len(raw)
            left, at = left + raw[at:x.start], x.end
        assert bytes(got[d].kept) == left + raw[at:]
        assert hashlib.sha256(bytes(got[d].kept)).hexdigest() == want[d][3] and len(got[d].spans) == want[d][2]
    assert [tuple(x) for x in got[2].spans] == [(0, 80), (85, 145)] and bytes(got[4].kept) == b"tail" and got[1].spans == []


def test_all_strings_of_a_bucket_are_ordered(monkeypatch):
    """Strings that are alone under their anchor go through the construction as the others do."""
    import pyarrow as pa
    seen = []
    monkeypatch.setattr(substring_dedup, "first_owner", lambda s, o, k: seen.extend(s) or collection_bwt.first_owner(s, o, k))
    rnd = random.Random(12)
    strings = [bytes(rnd.choice(b"abcdefgh") for _ in range(50 + i % 3)) for i in range(20)]
    row = lambda chunk, own: {"chunk": chunk, "bucket": 0, "text": substring_dedup._pack(b"".join(strings)),
                              "windows": bytes(len(s) - 49 for s in strings), "owners": substring_dedup._pack(np.array(own, np.int64).tobytes())}
    out = substring_dedup._owners_of_windows(pa.Table.from_pylist([row(1, range(20)), row(2, range(19, -1, -1))]))
    assert sorted(seen) == sorted(strings)
    want = [min(i, 19 - i) for i, s in enumerate(strings) for _ in range(len(s) - 49)]
    assert [np.frombuffer(substring_dedup._unpack(x), np.int64).tolist() for x in out["owners"].to_pylist()] == [want, want]


def dealt_in_process(docs, buckets=3):
    """The operator's steps one after the other without Spark, so that patched limits hold in all of them."""
    import pyarrow as pa
    together = lambda step, rows: [x for r in rows for b in step(iter([pa.RecordBatch.from_pylist([r])])) for x in b.to_pylist()]
    by = lambda rows, key: [[r for r in rows if r[key] == k] for k in sorted({r[key] for r in rows})]
    batch = pa.RecordBatch.from_arrays([pa.array(list(docs), pa.int64()), pa.array(list(docs.values()), pa.string())], names=["id", "text"])
    chunks = [x for b in substring_dedup.pack_chunks(iter([batch])) for x in b.to_pylist()]
    prints = together(substring_dedup._prints(buckets), chunks)
    answers = [x for g in by(prints, "bucket") for x in substring_dedup._answers(buckets)(pa.Table.from_pylist(g)).to_pylist()]
    asked = [r | {"answers": [a for a in answers if a["chunk"] == r["chunk"]] or None} for r in chunks]
    sent = together(substring_dedup._send_strings(buckets), [r for r in asked if r["answers"]])
    found = [x for g in by(sent, "bucket") for x in substring_dedup._owners_of_windows(pa.Table.from_pylist(g)).to_pylist()]
    return together(substring_dedup._apply(buckets), [r | {"found": [f for f in found if f["chunk"] == r["chunk"]]} for r in asked])


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize("clash", [False, True])
def test_buckets_order_small_collections(monkeypatch, hot, clash):
    """A bucket's strings are ordered in several collections, and no window is in two of them.  Strings whose hashes
    clash are not taken for equal."""
    monkeypatch.setattr(substring_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 1})())}))
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4000)
    if clash:
        monkeypatch.setattr(substring_dedup.Chunk, "_content_hashes", lambda self, start, n: (n % 2).astype(np.uint64) << np.uint64(9))
    calls, plain = [], collection_bwt.first_owner
    monkeypatch.setattr(substring_dedup, "first_owner", lambda s, o, k: calls.append(set(s)) or plain(s, o, k))
    rnd = random.Random(17)
    words = ["the", "of", "tion", "être", "日本", "a", "zzzz", "word", "other"]
    shared = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(12)]
    docs = {}
    for i in range(50):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(shared), rnd.choice(shared), "a" * rnd.choice([0, 10, 120])]
        rnd.shuffle(parts)
        docs[i * 7 % 53] = " ".join(parts)
    got = {r["id"]: (r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
           for r in dealt_in_process(docs)}
    assert got == brute_substrings({d: t.encode() for d, t in docs.items()})
    windows = [{s[i:i + 50] for s in strings for i in range(len(s) - 49)} for strings in calls]
    assert sum(map(len, windows)) == len(set().union(*windows))
    assert clash and not hot or len(calls) > 2 * 3  # of three buckets


def test_collection_order(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(collection_bwt, "_LONG", 4)
    monkeypatch.setattr(collection_bwt, "_BLOCK", 2)
    for _ in range(40):
        k = rnd.randint(1, 5)
        alphabet = rnd.choice([b"ab", b"abcdefgh", bytes(range(255))])
        strings = list({bytes(rnd.choice(alphabet) for _ in range(rnd.randint(k, 14))) for _ in range(rnd.randint(1, 40))})
        owners = np.array([rnd.randint(0, 20) for _ in strings])
        least = {}
        for s, o in zip(strings, owners):
            for i in range(len(s) - k + 1):
                least[s[i:i + k]] = min(least.get(s[i:i + k], 99), o)
        for s, g in zip(strings, collection_bwt.first_owner(strings, owners, k)):
            assert list(g) == [least[s[i:i + k]] for i in range(len(s) - k + 1)]


@pytest.mark.parametrize("leaf", [(512, 256), (100, 64), (4, 2)])
def test_order_sorts_only_new_symbols(monkeypatch, tmp_path, leaf):
    """Ranks and common prefixes are those of a plain sort; rounds sort the symbols before new suffixes, not all."""
    rnd, sizes, plain = random.Random(3), [], np.argsort
    monkeypatch.setattr(collection_bwt, "_LONG", leaf[0])
    monkeypatch.setattr(collection_bwt, "_BLOCK", leaf[1])
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or plain(x, *a, **k))
    strings = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60))) for _ in range(150)})
    ranks, lengths, prefixes = collection_bwt.build(strings, str(tmp_path))
    total = sum(map(len, strings))
    assert sum(sizes) <= 3 * (total + len(strings))
    assert [len(s) for s in strings] == list(lengths)
    order = sorted(((*s[len(s) - j:], 256 + i), i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert all(ranks[j, i] == r for r, (_, i, j) in enumerate(order))
    for r in range(1, len(order)):
        x, y = order[r - 1][0], order[r][0]
        assert prefixes[r] == next(k for k in range(len(x)) if x[k] != y[k])


def test_equal_windows_share_an_anchor(monkeypatch):
    monkeypatch.setattr(anchors, "_SLICE", 150)
    anchors._powers.cache_clear()
    rnd = random.Random(2)
    docs = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 400))) for _ in range(30)] + [b"x" * 300, b"x" * 99]
    ends = np.cumsum([len(d) for d in docs])
    start, n, h, doc = anchors.segments(np.frombuffer(b"".join(docs), np.uint8), ends)
    begin = np.concatenate([[0], ends[:-1]])
    seen, by = set(), {}
    for s, c, x, d in zip(start, n, h, doc):
        for w in range(s, s + c):
            assert begin[d] <= w and w + 50 <= ends[d]
            seen.add(w)
            assert by.setdefault(b"".join(docs)[w:w + 50], x) == x
    assert len(seen) == sum(max(0, len(d) - 49) for d in docs)
    anchors._powers.cache_clear()


# ---- decontamination -----------------------------------------------------------------------------
def test_decontamination(spark, odd, empty):
    rnd = random.Random(6)
    vocabulary = [f"t{i}" for i in range(30)]
    items = {i: " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 12, 20]))) for i in range(12)}
    docs = {}
    for i in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        if i % 3 == 0:
            x = items[rnd.randrange(12)].split()
            w[5:5] = x[rnd.randint(0, 3):]
        docs[i] = ", ".join(w).upper()
    get = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = {}
    for d, t in docs.items():
        w, hit, found = get(t), set(), set()
        for i, b in items.items():
            x = get(b)
            k = min(10, len(x))
            for s in range(max(len(x) - 9, 1)):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == x[s:s + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([*items.items(), (99, None), (98, ""), (0, items[0])], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(df, bench).collect()}
    assert got == want
    assert ids(decontam.contamination(odd, bench)) == ids(odd)
    assert decontam.contamination(empty, bench).count() == 0
    index = decontam.build_index(df)  # all words, so one index serves any benchmark
    assert index.where("term <> ''").count() == sum(len(get(t)) for t in docs.values())
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(df, bench, index=index).collect()}
    assert got == want
    none = decontam.contamination(df, bench.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and none.count() == 80


# ---- urls ----------------------------------------------------------------------------------------
def test_urls(spark):
    urls = ["https://A.Example.org/es/x?q#f", "http://example.org/en/1", "http://example.org/en/2", "http://org", "ftp://x.com/fr/", "http://x.com/de/1",
            "http://notexample.org.net/es/", None, "no scheme", "", "http://", "http://x.com", "http://a/b://c", "http://u.net/" + "p" * 5000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [got[i].rule for i in range(7)] == ["example.org/es/", "example.org/en/1", "org/", None, "com/fr/", "com/de/", None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.org", "/es/x", "block")
    assert (got[7].host, got[7].path, got[8].path, got[12].path) == ("", "", "", "/b://c")
    assert all(r.verdict in ("allow", "block") for r in got.values()) and len(got) == len(urls)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_model_learns(spark):
    good = [("allow.net", f"/news/{i}") for i in range(120)]
    bad = [("spam.biz", f"/casino/{i}") for i in range(120)]
    labelled = spark.createDataFrame([(h, p, float(h == "spam.biz")) for h, p in good[:80] + bad[:80]], "host string, path string, label double")
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(good[80:] + bad[80:])], "page_id long, url string")
    got = url_filter.filter_urls(pages, rules=(("allow", "nowhere/"),), labelled=labelled).collect()
    assert all((r.verdict == "block") == (r.page_id >= 40) for r in got)


# ---- languages -----------------------------------------------------------------------------------
def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 4 <> 2 AND lang IS NOT NULL"))
    held = docs.where("doc_id % 4 = 2")
    got = language_id.predict(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = spark.createDataFrame(rows(TEXTS), SCHEMA)
    by = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [by[i].lang_pred for i in range(3)] == ["und"] * 3 and by[3].lang_pred != "und" and by[0].score == 0
    assert language_id.predict(empty, model).count() == 0
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


# ---- mixing --------------------------------------------------------------------------------------
def test_raking_meets_the_margins(spark):
    rnd = random.Random(9)
    cells = [(s, la, t, float(rnd.randint(1, 1000))) for s in ("a", "b", None) for la in ("x", "y") for t in (0, 1, 2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens double")
    out = mixing.raked(df, targets={"source": {"a": 1, "b": 2, None: 1}}, shapes={"lang": 0.5, "topic": 0.0}).toPandas()
    assert np.allclose(out.groupby("topic").w.sum(), 1 / 3, atol=1e-11)
    assert np.allclose(out.groupby(out.source.fillna("-")).w.sum().loc[["a", "b", "-"]], [0.25, 0.5, 0.25], atol=1e-11)


def test_distributed_raking_takes_the_same_steps(spark, monkeypatch):
    rnd = random.Random(10)
    cells = [(s, la, float(rnd.randint(1, 1000))) for s in ("a", "b", None) for la in ("x", "y", None) if (s, la) != ("a", "x")]
    df = spark.createDataFrame(cells, "source string, lang string, tokens double")
    both = []
    for limit in (100, 0):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", limit)
        both.append({(r.source, r.lang): r.w for r in mixing.raked(df, ("source", "lang"), shapes={"source": 0.5, "lang": 0.0}, tolerance=1e-3).collect()})
    assert both[0] == pytest.approx(both[1], rel=1e-12) and len(both[0]) == 8


def test_raking_tells_what_it_cannot_meet(spark):
    # "a" has only "x": both margins cannot hold
    df = spark.createDataFrame([("a", "x", 5.0), ("b", "x", 5.0)], "source string, lang string, tokens double")
    with pytest.warns(UserWarning, match="off by"):
        mixing.raked(df, ("lang", "source"), {"source": {"a": 1, "b": 1}, "lang": {"x": 1, "y": 1}}, max_rounds=3)


def test_mix_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "some words here again", "s", "en", "law" if i % 2 else "art", 9.0, 3) for i in range(8)],
                                 "doc_id long, text string, source string, lang string, topic string, expected_copies double, n_tokens long")
    out = mixing.mix(docs)
    assert {r.input_topic for r in out.collect()} == {"law", "art"} and out.where("input_expected_copies <> 9 OR input_n_tokens <> 3").count() == 0
    assert out.where("n_tokens <> 4 OR topic < 0").count() == 0
    by_topic = mixing.mix(docs, topic_col="topic")
    assert {r.topic for r in by_topic.collect()} == {"law", "art"}
    assert by_topic.agg(F.sum("expected_copies")).first()[0] == pytest.approx(4)


def test_mix_odd(odd, empty):
    out = mixing.mix(odd)
    assert ids(out) == ids(odd) and out.where("doc_id IN (0, 1, 2) AND n_copies > 0").count() == 0
    assert mixing.mix(empty).count() == 0


def test_pipeline_on_odd_documents(spark, odd):
    import corpus_pipeline
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.lit("law").alias("topic"), F.lit(-5).alias("n_removed"))
    names = docs.columns
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names and docs.where("topic <> 'law' OR n_removed <> -5").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert all(r.n_copies > 0 for r in out.collect()) and out.count() <= docs.count()
