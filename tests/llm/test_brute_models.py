"""The registered op2 and op7 against plain versions: one n-gram at a time, a loop over centroids, NumPy regression."""

import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.ml.feature import HashingTF

from panelkit.llm import language_id as L
from panelkit.llm import url_filter as U
from panelkit.llm.queries_model import op2_language_id
from panelkit.llm.queries_web import op7_url_filter
from tests.conftest import SF_SMALL

M32 = 0xFFFFFFFF


def _slot(gram: str) -> int:
    h = 0
    for c, key in zip(gram, (2654435761, 2246822519, 3266489917), strict=False):
        h = ((h ^ ord(c)) * key) & M32
    return (((h ^ (h >> 15)) * 2246822519) & M32) >> (32 - L.BITS)


def _grams(text: str) -> Counter:
    plain = "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower())
    return Counter(_slot(plain[i:i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1))


def _unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def test_op2_equals_a_plain_nearest_centroid(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF_SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    train = [(i, t, lang) for i, t, lang in rows if not held[i] and lang is not None]
    by_lang = Counter(lang for _, _, lang in train)
    assert max(by_lang.values()) <= L.PER_LANG  # so the sample is every training row
    grams = {i: _grams(t or "") for i, t, _ in rows}
    df = Counter(s for i, _, _ in train for s in grams[i])
    idf = {s: np.float32(np.log((1 + len(train)) / (1 + df[s]))) + np.float32(0.01) for s in range(L.DIMS)}

    def vector(i):
        out = np.zeros(L.DIMS, np.float32)
        for s, n in grams[i].items():
            out[s] = np.float32(np.log1p(np.float32(n))) * idf[s]
        return _unit(out)

    vecs = {i: vector(i) for i, _, _ in rows}
    centroids = []
    for lang in sorted(by_lang):
        x = [vecs[i] for i, _, g in train if g == lang and vecs[i].any()]
        mean = sum(x) / len(x)
        starts = [max(range(len(x)), key=lambda j: float(x[j] @ mean))]
        while len(starts) < min(L.CLUSTERS, len(x)):
            starts.append(min(range(len(x)), key=lambda j: max(float(x[j] @ x[s]) for s in starts)))
        c = [x[s] for s in starts]
        for _ in range(L.ROUNDS):
            near = [max(range(len(c)), key=lambda k: float(v @ c[k])) for v in x]
            c = [_unit(sum(v for v, k in zip(x, near, strict=True) if k == j)) if j in near else c[j] for j in range(len(c))]
        centroids += [(lang, v) for v in c]
    got = {r.doc_id: r for r in op2_language_id(spark, SF_SMALL).collect()}
    assert set(got) == set(held) and len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i].held_out == held[i]
        if not L.has_letter(text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cos = [(float(vecs[i] @ v), lang) for lang, v in centroids]
        assert abs(got[i].score - max(cos)[0]) < 1e-4
        # the predicted label's best centroid is the nearest one, ties of the last bits aside
        assert max(s for s, lang in cos if lang == got[i].lang_pred) > max(cos)[0] - 1e-5


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def _rule(host, path):
    fits = []
    for verdict, rule in U.RULES:
        domain = rule[:rule.index("/")]
        if (host == domain or host.endswith("." + domain)) and path.startswith(rule[len(domain):]):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def _slots(host, path, tf):
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out |= {tf.indexOf(mark + text[i:i + n]) for n in U.SIZES for i in range(len(text) - n + 1)}
    return out


def _regression(x, y, lam=0.01, rounds=60):
    """Intercept and weights of the L2-penalised logistic loss on unit-variance columns, by Newton steps on K = ZZ'."""
    sd = x.std(axis=0, ddof=1)
    z = np.where(sd > 0, x / np.where(sd > 0, sd, 1), 0.0)
    n = len(y)
    k = z @ z.T
    beta, b = np.zeros(n), 0.0
    for _ in range(rounds):
        f = k @ beta + b
        p = 1 / (1 + np.exp(-f))
        w = np.maximum(p * (1 - p), 1e-10)
        a = np.zeros((n + 1, n + 1))
        a[:n, :n] = k + np.diag(lam * n / w)
        a[:n, n] = a[n, :n] = 1
        sol = np.linalg.solve(a, np.append(f + (y - p) / w, 0.0))
        beta, b = sol[:n], sol[n]
    return b, np.where(sd > 0, (z.T @ beta) / np.where(sd > 0, sd, 1), 0.0)


def test_op7_equals_plain_rules_and_regression(spark):
    rows = duckdb.sql(f"SELECT page_id, url FROM '{SF_SMALL}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in op7_url_filter(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    parts = {i: _split(u) for i, u in rows}
    ruled = {i: _rule(*parts[i]) for i, _ in rows}
    for i, _ in rows:
        assert (got[i].host, got[i].path, got[i].rule) == (*parts[i], ruled[i][0])
        assert ruled[i][1] in (None, got[i].verdict)
    tf = HashingTF(numFeatures=U.FEATURES, binary=True)
    labelled = sorted({(*parts[i], ruled[i][1] == "block") for i, _ in rows if ruled[i][0]})
    assert 2 < len(labelled) <= U.TRAIN_ROWS  # every labelled url is learned from
    x = np.zeros((len(labelled), U.FEATURES))
    for r, (host, path, _) in enumerate(labelled):
        x[r, list(_slots(host, path, tf))] = 1
    b, w = _regression(x, np.array([float(v) for _, _, v in labelled]))
    for host, path in sorted({parts[i] for i, _ in rows})[::7]:
        i = next(i for i, _ in rows if parts[i] == (host, path))
        p = 1 / (1 + np.exp(-(b + w[list(_slots(host, path, tf))].sum())))
        assert abs(got[i].score - p) < 0.02
        if ruled[i][0] is None and abs(p - 0.5) > 0.02:
            assert got[i].verdict == ("block" if p > 0.5 else "allow")
