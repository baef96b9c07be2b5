"""Periods of a group as bit words.

A period p is bit ``p & 31`` of word ``p >> 5`` (both exact for every integer, negative ones included), so the distinct
periods of a group are a few longs that ``bit_or`` combines before and after the shuffle: no distinct (group, period)
rows and no window.  Periods that span at most ``MAX_COLUMNS`` words (512 periods) are one aggregate column a word and
so one exchange; wider ones are aggregated as (group, word) rows first, which a second, small exchange gathers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SHIFT = 5
BITS = 1 << SHIFT
FULL = (1 << BITS) - 1
MAX_COLUMNS = 16


class Span(NamedTuple):
    """All periods of a table: how many distinct ones, first and last word (None without periods)."""

    n_periods: int
    first: int | None
    last: int | None


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _with_bits(df: DataFrame, keys, period: str) -> DataFrame:
    kind = df.schema[period].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"periods must be integers; {period} is {kind.simpleString()}")
    p = F.col(period).cast("long")
    return (df.where(F.col(period).isNotNull())
            .select(*keys, F.shiftright(p, SHIFT).alias("__word"),
                    _shift("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(BITS - 1))).alias("__bit")))


def period_span(df: DataFrame, period: str) -> Span:
    """Number of distinct periods and their words: one aggregate with a row a word, reduced to one row."""
    words = _with_bits(df, (), period).groupBy("__word").agg(F.bit_or("__bit").alias("bits"))
    n, first, last = words.agg(F.sum(F.bit_count("bits")), F.min("__word"), F.max("__word")).first()
    return Span(int(n or 0), first, last)


def period_words(df: DataFrame, keys, period: str, span: Span | None = None) -> DataFrame:
    """``keys`` and ``words`` (array of ``{word, bits}``, ascending, no empty word).  Rows without a period are left
    out; a null key is a group of its own."""
    keys = list(keys)
    span = span or period_span(df, period)
    rows = _with_bits(df, keys, period)
    if span.first is None or span.last - span.first < MAX_COLUMNS:
        wanted = range(span.first, span.last + 1) if span.first is not None else range(1)
        got = rows.groupBy(*keys).agg(*[
            F.coalesce(F.bit_or(F.when(F.col("__word") == w, F.col("__bit"))), F.lit(0).cast("long")).alias(f"__w{i}")
            for i, w in enumerate(wanted)])
        words = F.array(*[F.struct(F.lit(w).cast("long").alias("word"), F.col(f"__w{i}").alias("bits"))
                          for i, w in enumerate(wanted)])
        return got.select(*keys, F.filter(words, lambda x: x["bits"] != 0).alias("words"))
    per_word = rows.groupBy(*keys, "__word").agg(F.bit_or("__bit").alias("__bits"))
    return per_word.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(F.col("__word").alias("word"), F.col("__bits").alias("bits")))).alias("words"))


def periods_of(words: Column, kind: str = "int") -> Column:
    """The sorted periods that the words hold."""
    places = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(places, lambda i: _shift("shiftright", w["bits"], i).bitwiseAND(F.lit(1)) == 1),
        lambda i: (w["word"] * BITS + i).cast(kind))))


def _inner_run(bits: Column) -> Column:
    """Longest run of ones of one word: how often ``x & (x >> 1)`` can be taken before nothing is left."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(BITS)),
                       F.struct(F.lit(0).alias("n"), bits.alias("x")),
                       lambda acc, _i: F.struct((acc["n"] + F.when(acc["x"] != 0, 1).otherwise(0)).alias("n"),
                                                acc["x"].bitwiseAND(F.shiftright(acc["x"], 1)).alias("x")),
                       lambda acc: acc["n"])


def longest_run_of(words: Column) -> Column:
    """Longest run of consecutive periods, over the words in order: a run that reaches a word's last bit goes on in
    the next word if that is its neighbour."""
    def step(acc, w):
        x = w["bits"]
        carried = F.when(w["word"] == acc["word"] + 1, acc["carry"]).otherwise(0)
        # ones at the low end: the lowest zero bit, less one, has as many ones
        low = F.bit_count(F.bitwise_not(x).bitwiseAND(x + 1) - 1).cast("int")
        gaps = F.bitwise_not(x).bitwiseAND(F.lit(FULL))
        high = F.when(x == FULL, carried + BITS).otherwise(F.lit(BITS) - F.length(F.bin(gaps)))
        return F.struct(w["word"].alias("word"), high.cast("int").alias("carry"),
                        F.greatest(acc["best"], carried + low, _inner_run(x)).cast("int").alias("best"))

    first = F.element_at(words, 1)["word"]
    return F.aggregate(words, F.struct(first.alias("word"), F.lit(0).alias("carry"), F.lit(0).alias("best")),
                       step, lambda acc: acc["best"])
