"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

The vocabulary (pieces and scores) comes from a public SentencePiece model file; its pieces are used as a
unigram model with their own scores.  An Aho-Corasick automaton lists every vocabulary match; dynamic
programming over end positions carries the best score and its number of pieces, no back pointers.

Tie rule of the unigram tokenizer (Hugging Face ``tokenizers`` ``Unigram``): matches ending at a position
are offered from the earliest start on, and only a strictly better score replaces an earlier offer.  A
character that is no piece by itself is also offered as unknown, at the lowest score less 10; it is spelled
in byte pieces, so it counts as many tokens as it has UTF-8 bytes.  Scores of the file are whole numbers, so
sums are exact and a text may be cut where no piece reaches across: before each space that follows another
character.  Words are therefore solved once and remembered (a bounded memory per worker).

Text form, as the vocabulary's own: a space is written as U+2581 and one is put before the text.

Defined cases: a null text has null counts, an empty one 0; texts are counted whole; repeated rows get equal
results; a null id is carried through; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import map_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNK_PENALTY = 10.0
SHARED = 6  # many words begin alike: the search over this many characters is remembered too
REMEMBERED = 400_000  # words kept per worker; beyond that the memory starts afresh


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The file's ordinary pieces with their scores (tens of thousands at most)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


class _Node(dict):
    """A state of the Aho-Corasick automaton: its transitions, where to go on failure, and the pieces that
    end here as (length, score), longest first.  Transitions that only fail are filled in when first used."""

    __slots__ = ("fail", "ends")

    def __missing__(self, c: str) -> _Node:
        to = self[c] = self.fail[c] if self.fail is not None else self
        return to


def automaton(pieces) -> _Node:
    def node():
        made = _Node()
        made.fail, made.ends = None, ()
        return made

    root = node()
    for piece, score in pieces:
        at = root
        for c in piece:
            if c not in at:
                at[c] = node()
            at = at[c]
        at.ends = ((len(piece), score),)
    level = []
    for child in root.values():
        child.fail = root
        level.append(child)
    while level:  # by depth, before any transition is filled in
        below = []
        for at in level:
            for c, child in at.items():
                fall = at.fail
                while fall is not None and c not in fall:
                    fall = fall.fail
                child.fail = root if fall is None else fall[c]
                child.ends += child.fail.ends
                below.append(child)
        level = below
    return root


class Counter(dict):
    """Maps a unit of text to (best score, pieces)."""

    def __init__(self, pieces):
        super().__init__()
        self.begun: dict[str, tuple] = {}  # the search after the first SHARED characters
        pieces = list(pieces)
        self.root = automaton(pieces)
        self.unknown = min(s for _, s in pieces) - UNK_PENALTY
        # may a text be cut before a space that follows another character, and around line ends?
        self.cuts = all(float(s).is_integer() for _, s in pieces) and not any(
            SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces)
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n") if self.cuts else re.compile("(?s).+")

    def advance(self, unit: str, best: list, count: list, state: _Node):
        """Carry the search over the rest of ``unit``, of which ``len(best) - 1`` characters are done."""
        unknown = self.unknown
        for end in range(len(best), len(unit) + 1):
            c = unit[end - 1]
            state = state[c]
            top, length = float("-inf"), 0
            for length, score in state.ends:  # longest first: the earliest start is offered first
                total = best[end - length] + score
                if total > top:
                    top, begin = total, end - length
            if length != 1 and best[-1] + unknown > top:  # no piece by itself
                best.append(best[-1] + unknown)
                count.append(count[-1] + len(c.encode()))
            else:
                best.append(top)
                count.append(count[begin] + 1)
        return best, count, state

    def solve(self, unit: str) -> tuple[float, int]:
        if len(unit) <= SHARED:
            best, count, _ = self.advance(unit, [0.0], [0], self.root)
        else:
            start = unit[:SHARED]
            if (known := self.begun.get(start)) is None:
                if len(self.begun) >= REMEMBERED:
                    self.begun.clear()
                known = self.begun[start] = self.advance(start, [0.0], [0], self.root)
            best, count, _ = self.advance(unit, known[0][:], known[1][:], known[2])
        return best[-1], count[-1]

    def __missing__(self, word: str) -> tuple[float, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.solve(word)
        return value

    def count(self, text: str | None) -> tuple[float | None, int | None]:
        if text is None:
            return None, None
        if not text:
            return 0.0, 0
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        found = [self[u] for u in units] if self.cuts else [self.solve(u) for u in units]
        return sum(x[0] for x in found), sum(x[1] for x in found)


_counters: dict[int, Counter] = {}


def _counter(sent) -> Counter:
    """One automaton per Python worker and vocabulary."""
    pieces = sent.value
    key = hash(pieces)
    if key not in _counters:
        _counters[key] = Counter(pieces)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens`` (long), ``score`` (sum of the best path's piece scores).
    The driver reads the vocabulary file and broadcasts it (its size is fixed by the file)."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(read_vocabulary(vocabulary)))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(**cols):
        count = _counter(sent).count
        found = [count(t) for t in cols["__text"]]
        return {id_col: cols[id_col], "n_tokens": [n for _, n in found], "score": [s for s, _ in found]}

    return map_columns(docs.select(id_col, F.col(text_col).alias("__text")), run,
                       f"`{id_col}` {kind}, n_tokens long, score double")
