"""Secret scan with one combined deterministic automaton.

All rules are compiled into one byte automaton (``automaton.Dfa``: subset construction, minimisation,
transition array) and every text is read once, byte by byte, for all rules together.  An accepting state
names the rules of which a match ends here; the start is then found by the rule's reversed automaton
(farthest back, not before the rule's previous match) and the end by its anchored automaton (farthest on).
That gives, per rule, the leftmost longest non-overlapping matches.  It needs what holds for all rules
below: no match of a rule ends before the first end of an earlier-starting match of the same rule.

A match that fails its rule's length test is dropped *after* matching, so it still uses up its text.
Offsets are code points, end exclusive.

Defined cases: a null or empty text has no spans; texts are scanned whole; repeated rows get equal results;
a null id is carried through; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache
from operator import length_hint

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import map_columns


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: bytes
    group: int  # the length test applies to this group of the pattern
    min_chars: int


# ``hex`` counts inside the automaton: its runs cannot overlap, so {32,} keeps the same matches as the
# length test after ``+``, without a stop at every short run.
BASE_RULES = (
    SecretRule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", rb"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", rb"[0-9a-f]{32,}", 0, 32),
)
# Published formats of access tokens, besides the base rules.
MORE_RULES = (
    SecretRule("github", rb"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("private_key", rb"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 0),
)
RULES = BASE_RULES + MORE_RULES


class _Accept:
    """Stands in the transition arrays for an accepting state.  It cannot be indexed, so the scan loop,
    which does nothing but ``row = row[byte]``, stops there by itself."""

    def __init__(self, row: list, rules: list[int]):
        self.row, self.rules = row, rules


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        from panelkit.llm.automaton import Dfa

        self.rules = rules
        both = Dfa([r.pattern for r in rules], anywhere=True)
        self.classes = both.classes
        # one array per state, holding the next states' arrays themselves
        rows = {s: [] for s in range(0, len(both.table), both.width)}
        enter = {s: _Accept(row, [k for k in range(len(rules)) if both.accepts[s] >> k & 1]) if s in both.accepts else row
                 for s, row in rows.items()}
        for s, row in rows.items():
            row += [enter[t] for t in both.table[s:s + both.width]]
        self.start = enter[both.start]
        self.ahead = [Dfa([r.pattern], anywhere=False) for r in rules]
        self.back = [Dfa([r.pattern], anywhere=False, backwards=True) for r in rules]
        self.exact = [re.compile(r.pattern) for r in rules]

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted."""
        done, found, row, n = [0] * len(self.rules), [], self.start, len(data)
        rest = iter(data.translate(self.classes) + b"\0")  # one byte more, to stop after a match at the end
        while True:
            try:
                for c in rest:
                    row = row[c]
                return sorted(found)
            except TypeError:  # row accepts; c is the byte after the match
                if not isinstance(row, _Accept):
                    raise
            at = n - length_hint(rest)
            for k in row.rules:
                if at > done[k] and (begin := self.back[k].longest(data, at, done[k], -1)) >= 0:
                    done[k] = end = self.ahead[k].longest(data, begin, n)
                    rule = self.rules[k]
                    if not rule.min_chars or len(self.exact[k].fullmatch(data, begin, end)[rule.group]) >= rule.min_chars:
                        found.append((begin, k, end))
            row = row.row[c]

    def spans(self, text: str | None) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, by start, then in the rules' order."""
        if not text:
            return []
        data = text.encode()
        found = self.byte_spans(data)
        if len(data) != len(text):
            found = [(b := len(data[:x].decode()), k, b + len(data[x:y].decode())) for x, k, y in found]
        return [(x, self.rules[k].kind, y) for x, k, y in found]


@cache
def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    """One compiled scanner per Python worker."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, an array of (start, kind, end)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def scan(**cols):
        find = scanner(rules).spans
        return {id_col: cols[id_col], "found": [[{"start": a, "kind": k, "end": b} for a, k, b in find(t)] for t in cols["__text"]]}

    return map_columns(docs.select(id_col, F.col(text_col).alias("__text")), scan,
                       f"`{id_col}` {kind}, found array<struct<start:long,kind:string,end:long>>")


def joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def base_digest(found) -> str:
    """SHA-256 of the base rules' spans, for comparisons in Python."""
    base = {r.kind for r in BASE_RULES}
    return hashlib.sha256(joined(x for x in found if x[1] in base).encode()).hexdigest()


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and text form of the spans of ``find_secrets`` under all rules."""
    found = find_secrets(docs)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
