"""Deterministic row sampling.

``DataFrame.sample`` depends on the partition layout (the same seed keeps
different rows after a repartition), so a sample that must be reproducible
across runs and cluster sizes is drawn from a hash of a row key instead: a
Lehmer-style multiplicative hash modulo the Mersenne prime 2^31 - 1, which
any engine computes identically with 64-bit integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647
MULTIPLIER = 48271
BUCKETS = 10000


def hash_bucket(key: Column, seed: int = 42) -> Column:
    # reduced first, so that keys near the ends of the 64-bit range do not overflow
    return F.pmod(F.pmod(F.pmod(key.cast("long"), F.lit(MODULUS)) * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS)), F.lit(BUCKETS))


def text_bucket(keys: list[Column], seed: int = 42) -> Column:
    """Bucket of keys of any type, by their text form (MD5, which every engine computes alike)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(BUCKETS)


def hash_sample(df: DataFrame, key: str | list[str], fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """Rows whose key hashes below ``fraction``: same rows on every layout."""
    keys = [key] if isinstance(key, str) else list(key)
    if len(keys) == 1 and df.schema[keys[0]].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        bucket = hash_bucket(F.col(keys[0]), seed)
    else:  # text and other types, several columns
        bucket = text_bucket([F.col(k) for k in keys], seed)
    return df.where(bucket < F.lit(int(round(fraction * BUCKETS))))
