"""Quality rules as a short-circuit cascade.

Every rule rejects a document by one statistic of its text.  Statistics are computed on demand and kept
per document, so a document pays only for the rules it reaches.  Before the run, a bounded sample of the
documents is scored by *all* rules: each rule's mean cost (seconds per document, its statistics included)
and the set of sampled documents that it rejects.  Rules are then ordered greedily by
``rejected among the documents still in / cost``, so cheap rules that reject much come first.  The verdict
is a conjunction and does not depend on that order; only the work does.

Defined cases: a null or empty text has no words and fails ``min_words``; every row is judged on its own,
so repeated rows get equal results; a null id is carried through; other columns are ignored; an empty
table gives an empty result (the sample is then empty and the listed order is used).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import WS, map_columns, small_batches

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
SAMPLE_DOCS = 2000  # bound of the sample that orders the rules


class Stats:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        try:
            made = _STATS[name]
        except KeyError:
            raise AttributeError(name) from None
        value = self.__dict__[name] = made(self)
        return value


def repeated_words(words: list[bytes], k: int = REPEAT_WINDOW) -> int:
    """Words inside a ``k``-word window that occurs twice or more in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + k - max(i, end)
            end = i + k
    return covered


_STATS: dict[str, Callable[[Stats], object]] = {
    # bytes.split() splits at ASCII white space only, which is exactly the word rule
    "words": lambda s: s.text.encode().split(),
    "n_words": lambda s: len(s.words),
    "word_chars": lambda s: len(s.text) - sum(map(s.text.count, WS)),
    "n_symbols": lambda s: sum(map(s.text.count, SYMBOLS)),
    "n_digits": lambda s: sum(map(s.text.count, "0123456789")),
    "lines": lambda s: [x for x in s.text.split("\n") if x.strip(WS)],
    "n_lines": lambda s: len(s.lines),
    "n_dup_lines": lambda s: len(s.lines) - len(set(s.lines)),
    "n_bullet_lines": lambda s: sum(x.lstrip(WS).startswith(("-", "*", "•")) for x in s.lines),
    "n_ellipsis_lines": lambda s: sum(x.rstrip(WS).endswith(("...", "…")) for x in s.lines),
    "n_repeat_words": lambda s: repeated_words(s.words),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], bool]


RULES = (
    Rule("min_words", lambda s: s.n_words < 20),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 30 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words),
    Rule("word_length", lambda s: s.word_chars < 2 * s.n_words or s.word_chars > 20 * s.n_words),
    Rule("digits", lambda s: 100 * s.n_digits > 25 * s.word_chars),
    Rule("duplicate_lines", lambda s: 100 * s.n_dup_lines > 30 * s.n_lines),
    Rule("bullets", lambda s: 100 * s.n_bullet_lines > 90 * s.n_lines),
    Rule("ellipses", lambda s: 100 * s.n_ellipsis_lines > 30 * s.n_lines),
)


def measure(text: str | None, rules: Iterable[Rule]) -> tuple[int, list[float]]:
    """Bit mask of the rules that reject a text, and each rule's seconds from a fresh start."""
    mask, costs = 0, []
    for k, r in enumerate(rules):
        began = time.perf_counter()
        mask |= bool(r.rejects(Stats(text))) << k
        costs.append(time.perf_counter() - began)
    return mask, costs


def greedy_order(masks: list[int], costs: list[float]) -> list[int]:
    """Rules by rejections among the documents not yet rejected, per cost; ties by listing order."""
    left, order, rest = list(masks), [], list(range(len(costs)))
    while rest:
        best = max(rest, key=lambda k: (sum(m >> k & 1 for m in left) / max(costs[k], 1e-9), -costs[k], -k))
        order.append(best)
        rest.remove(best)
        left = [m for m in left if not m >> best & 1]
    return order


def plan_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
               sample_docs: int = SAMPLE_DOCS) -> list[int]:
    """Cascade order from a sample of about ``sample_docs`` documents, taken by hash of id and text
    length (never more than twice as many rows come back)."""
    n = docs.count()
    keep = min(1.0, sample_docs / max(n, 1))
    part = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(1_000_000)) < int(keep * 1_000_000) + 1

    def score(text):
        found = [measure(t, rules) for t in text]
        return {"mask": [m for m, _ in found], "costs": [c for _, c in found]}

    rows = (map_columns(docs.where(part).select(F.col(text_col).alias("text")), score, "mask long, costs array<double>")
            .limit(2 * sample_docs).collect())
    if not rows:
        return list(range(len(rules)))
    return greedy_order([r.mask for r in rows],
                        [sum(r.costs[k] for r in rows) / len(rows) for k in range(len(rules))])


def cascade(text: str | None, rules, order) -> tuple[Stats, str | None, int]:
    """The text's statistics so far, the first rule that rejects it (None: kept), rules evaluated."""
    s = Stats(text)
    for done, k in enumerate(order, 1):
        if rules[k].rejects(s):
            return s, rules[k].name, done
    return s, None, len(order)


def quality_verdicts(docs: DataFrame, rules=RULES, stats=BASE, id_col: str = "doc_id",
                     text_col: str = "text", order: list[int] | None = None) -> DataFrame:
    """One row per input row: id, the asked ``stats`` (long; these are computed for every row), ``kept``,
    ``failed_rule`` (the cascade's first rejecting rule) and ``rules_run``."""
    order = plan_rules(docs, rules, id_col, text_col) if order is None else order
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + "".join(f"{x} long, " for x in stats) + "kept boolean, failed_rule string, rules_run int"

    def judge(**cols):
        out = {id_col: cols[id_col], **{x: [] for x in stats}, "kept": [], "failed_rule": [], "rules_run": []}
        for t in cols["__text"]:
            s, failed, ran = cascade(t, rules, order)
            for x in stats:
                out[x].append(getattr(s, x))
            out["kept"].append(failed is None)
            out["failed_rule"].append(failed)
            out["rules_run"].append(ran)
        return out

    return map_columns(docs.select(id_col, F.col(text_col).alias("__text")), judge, schema)


def keep_quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, all columns as they were; the cascade stops at the first
    rejection and computes nothing that it does not need."""
    order = plan_rules(docs, rules, id_col, text_col)
    at = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([cascade(t, rules, order)[1] is None for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
