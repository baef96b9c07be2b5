"""State and region of a geography identifier, as column expressions.

State: ids starting ``1400000US`` (tract) or ``8600000US`` (ZIP area) carry a
two-character code at positions 10-11; ``ZCTA5`` ids give the literal
``ZCTA``; any other id is read at the two characters starting five from the
end.  The code is looked up in the FIPS table, ``Unknown`` when absent.
(A ZIP's first two digits are read as a FIPS code; kept on purpose.)

Region: only for ``1400000US`` ids with exactly 11 characters after the
prefix, from the same code; ``Unknown`` otherwise or for territories.

The lookup is a literal map folded into the projection (no join).  A
broadcast-join form over the 57-row table is offered for callers that want a
dimension table (`tag_geo_join`).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.schema import FIPS_STATES, REGION_FIPS, fips_table

TRACT = "1400000US"
ZIP_AREA = "8600000US"
ZCTA = "ZCTA5"
UNKNOWN = "Unknown"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def state_code(geo) -> Column:
    g = _col(geo)
    return (F.when(g.startswith(TRACT) | g.startswith(ZIP_AREA), F.substring(g, 10, 2))
            .otherwise(F.substring(g, -5, 2)))


def region_code(geo) -> Column:
    g = _col(geo)
    return F.when(g.startswith(TRACT) & (F.length(g) == len(TRACT) + 11), F.substring(g, 10, 2))


def state_of(geo) -> Column:
    g = _col(geo)
    looked_up = F.coalesce(F.try_element_at(_literal_map(FIPS_STATES), state_code(g)), F.lit(UNKNOWN))
    return F.when(g.isNull(), F.lit(None).cast("string")).when(
        g.startswith(ZCTA), F.lit("ZCTA")).otherwise(looked_up)


def region_of(geo) -> Column:
    region_by_code = {code: region for region, codes in REGION_FIPS.items() for code in codes}
    looked_up = F.try_element_at(_literal_map(region_by_code), region_code(geo))
    return F.when(_col(geo).isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(looked_up, F.lit(UNKNOWN)))


def tag_geo(df: DataFrame, geo_col: str = "geo_id") -> DataFrame:
    """Add ``state`` and ``region`` columns (pure projection)."""
    return df.withColumn("state", state_of(geo_col)).withColumn("region", region_of(geo_col))


def tag_geo_join(df: DataFrame, geo_col: str = "geo_id") -> DataFrame:
    """Same result through a broadcast left join to the fixed 57-row table."""
    spark = df.sparkSession
    lookup = F.broadcast(fips_table(spark))
    g = F.col(geo_col)
    keyed = (df.withColumn("_state_code", state_code(g))
             .withColumn("_region_code", region_code(g)))
    s = lookup.select(F.col("fips").alias("_s_fips"), F.col("state_name").alias("_s_name"))
    r = lookup.select(F.col("fips").alias("_r_fips"), F.col("region_name").alias("_r_name"))
    out = (keyed.join(s, keyed["_state_code"] == s["_s_fips"], "left")
           .join(r, keyed["_region_code"] == r["_r_fips"], "left"))
    return (out.withColumn("state", F.when(g.isNull(), None).when(g.startswith(ZCTA), "ZCTA")
                           .otherwise(F.coalesce("_s_name", F.lit(UNKNOWN))))
            .withColumn("region", F.when(g.isNull(), None).otherwise(F.coalesce("_r_name", F.lit(UNKNOWN))))
            .drop("_state_code", "_region_code", "_s_fips", "_s_name", "_r_fips", "_r_name"))
