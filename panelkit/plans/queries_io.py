"""Registered queries: ACS tree scan, storage round trips, end-to-end run.

The driver tables carry no ACS files, so ``_acs_tree`` derives one from the
supplier x year panel with a Spark job (written below the shared checkpoint
folder): two tables per vintage, quoted names with commas, MOE columns, a
trailing blank header, short rows (suppkey % 11 = 5 in T1 stop before the
price), long rows (% 13 = 6 carry extra cells), rows without GEO_ID
(% 10 = 3, keyed by NAME) and, in T2, a later duplicate of every row with
suppkey % 9 = 0 whose count is "-" (the null must win).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.functions.cells import year_from_path
from panelkit.operators import stats as SS
from panelkit.operators.common import materialise
from panelkit.plans import sqlparts as Q
from panelkit.plans.flow import run_flow
from panelkit.plans.queries import REGISTRY, _round_all, query
from panelkit.schema import GEO, VALUE, VARIABLE, YEAR
from panelkit.session import scratch_path
from panelkit.sources import acs, storage
from panelkit.sources import tables as T

T1 = ["avg_qty", "avg_price"]
T2 = ["avg_disc", "avg_tax", "n_lines"]
def _moe():
    return F.lit('"*****"')


def _acs_tree(spark, sf) -> str:
    # The panel feeds three branches of the tree: computed once.
    w = materialise(T.supplier_year_wide(spark, sf).withColumn("k", F.col(GEO).cast("long")))
    k = F.col("k")
    gid = F.concat(F.lit("1400000US"), T.fips_pick(k), F.lpad(k.cast("string"), 9, "0"))
    name = F.concat(F.lit("Supplier "), k.cast("string"), F.lit(", Tract "), (k % 7).cast("string"))
    geo_cell = F.when(k % 10 == 3, F.lit('""')).otherwise(acs.quote(gid))
    num = lambda c: F.col(c).cast("string")
    head = [geo_cell, acs.quote(name)]
    t1_full = F.concat_ws(",", *head, num("avg_qty"), _moe(), num("avg_price"), _moe(), F.lit(""))
    t1_short = F.concat_ws(",", *head, num("avg_qty"), _moe())
    t1_line = (F.when(k % 11 == 5, t1_short)
               .when(k % 13 == 6, F.concat(t1_full, F.lit(",999,888"))).otherwise(t1_full))
    t1 = w.select(YEAR, k.alias("ord"), t1_line.alias("line"))
    n_text = F.concat(F.lit('"'), F.format_number(F.col("n_lines"), 0),
                      F.when(F.col("n_lines") > 50, F.lit("+")).otherwise(F.lit("")), F.lit('"'))

    def t2_line(n_cell):
        return F.concat_ws(",", *head, num("avg_disc"), _moe(), num("avg_tax"), _moe(), n_cell, _moe(), F.lit(""))
    t2 = (w.select(YEAR, k.alias("ord"), t2_line(n_text).alias("line"))
          .unionByName(w.where(k % 9 == 0).select(YEAR, (k + 1000000000).alias("ord"),
                                                  t2_line(F.lit("-")).alias("line"))))
    root = scratch_path(spark, "acs")
    acs.write_acs_tree(root, {"T1": (T1, t1), "T2": (T2, t2)})
    return root


_G = f"""g AS (SELECT *, CASE WHEN k % 10 = 3 THEN 'Supplier ' || k || ', Tract ' || (k % 7)
       ELSE '1400000US' || {Q.fips_pick_sql('k')} || lpad(CAST(k AS VARCHAR), 9, '0') END AS gid
     FROM (SELECT *, CAST(geo_id AS BIGINT) AS k FROM ({Q.SUPPLIER_WIDE})))"""


@query("acs_scan", f"""WITH {_G}
SELECT gid AS geo_id, year, variable, {Q.r6('value')} AS value FROM (
  SELECT gid, year, 'avg_qty' AS variable, avg_qty AS value FROM g
  UNION ALL SELECT gid, year, 'avg_price', avg_price FROM g WHERE k % 11 <> 5
  UNION ALL SELECT gid, year, 'avg_disc', avg_disc FROM g
  UNION ALL SELECT gid, year, 'avg_tax', avg_tax FROM g
  UNION ALL SELECT gid, year, 'n_lines', CASE WHEN k % 9 = 0 THEN NULL ELSE n_lines END FROM g)""")
def q_acs_scan(spark, sf):
    return _round_all(acs.scan_acs(spark, _acs_tree(spark, sf), file_glob="*.txt"), {VALUE})


def q_acs_stream_ingest(spark, sf):
    """The same tree through Structured Streaming: a file-source stream
    (availableNow) appends the scanned cells of each micro-batch to a log,
    merged on read -- equal to the batch scan."""
    from panelkit.streaming.ingest import read_ingested, start_acs_ingest
    root = _acs_tree(spark, sf)
    log = scratch_path(spark, "stream-log")
    q = start_acs_ingest(spark, root, log, file_glob="*.txt", max_files_per_trigger=4,
                         checkpoint_location=scratch_path(spark, "stream-ckpt"), available_now=True)
    q.awaitTermination()
    return _round_all(read_ingested(spark, log), {VALUE})


@query("acs_geo_dim", f"""WITH {_G}
SELECT gid AS geo_id, year, 'Supplier ' || k || ', Tract ' || (k % 7) AS name,
  {Q.state_sql('gid')} AS state, {Q.region_sql('gid')} AS region FROM g""")
def q_acs_geo_dim(spark, sf):
    return acs.geo_dim(spark, _acs_tree(spark, sf), file_glob="*.txt")


@query("year_from_path", f"""WITH {_G}
SELECT 'T1' AS tbl, year, count(*) AS n_rows FROM g GROUP BY year
UNION ALL SELECT 'T2' AS tbl, year, count(*) + count(*) FILTER (WHERE k % 9 = 0) AS n_rows FROM g GROUP BY year""")
def q_year_from_path(spark, sf):
    rows = acs.scan_cells(spark, _acs_tree(spark, sf), file_glob="*.txt", rows_only=True)
    return (rows.groupBy("src_path").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.regexp_extract("src_path", r"tbl=([^/]+)", 1).alias("tbl"),
                    year_from_path("src_path").alias(YEAR), "n_rows"))


@query("drop_moe", f"""WITH {_G}
SELECT variable, count(*) AS n_cells FROM (
  SELECT 'avg_qty' AS variable FROM g
  UNION ALL SELECT 'avg_price' FROM g WHERE k % 11 <> 5
  UNION ALL SELECT 'avg_disc' FROM g UNION ALL SELECT 'avg_disc' FROM g WHERE k % 9 = 0
  UNION ALL SELECT 'avg_tax' FROM g UNION ALL SELECT 'avg_tax' FROM g WHERE k % 9 = 0
  UNION ALL SELECT 'n_lines' FROM g UNION ALL SELECT 'n_lines' FROM g WHERE k % 9 = 0) GROUP BY variable""")
def q_drop_moe(spark, sf):
    cells = acs.scan_cells(spark, _acs_tree(spark, sf), file_glob="*.txt")
    return cells.groupBy(VARIABLE).agg(F.count(F.lit(1)).alias("n_cells"))


@query("ragged_rows", f"""WITH {_G}
SELECT gid AS geo_id, year, CASE WHEN k % 11 = 5 THEN 1 ELSE 2 END AS n_cells FROM g""")
def q_ragged_rows(spark, sf):
    cells = acs.scan_cells(spark, _acs_tree(spark, sf), ["avg_qty", "avg_price"], file_glob="*.txt")
    return (cells.groupBy(GEO, YEAR, "src_path", "src_blk", "src_pos")
            .agg(F.count(F.lit(1)).cast("int").alias("n_cells"))
            .select(GEO, YEAR, "n_cells"))


@query("panel_json_roundtrip", f"SELECT geo_id, year, variable, {Q.r6('value')} AS value FROM ({Q.SUPPLIER_PANEL})")
def q_panel_json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    storage.save_panel_json(T.supplier_year_panel(spark, sf), path)
    return _round_all(storage.load_panel_json(spark, path), {VALUE})


@query("panel_parquet_roundtrip", f"SELECT geo_id, year, variable, {Q.r6('value')} AS value FROM ({Q.SUPPLIER_PANEL})")
def q_panel_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "parquet")
    storage.save_panel_parquet(T.supplier_year_panel(spark, sf), path)
    return _round_all(storage.load_panel_parquet(spark, path), {VALUE})


@query("load_features", f"""SELECT geo_id, year, {", ".join(f"{Q.r6(f)} AS {f}" for f in T.SUPPLIER_FEATURES)} FROM ({Q.SUPPLIER_WIDE})
UNION ALL SELECT NULL, CAST(range AS INTEGER), {", ".join("NULL" for _ in T.SUPPLIER_FEATURES)} FROM range(1990, 2001)
WHERE range NOT IN (SELECT year FROM ({Q.SUPPLIER_WIDE}))""")
def q_load_features(spark, sf):
    """Reloaded records, and a row without geography for every expected year that is absent."""
    path = scratch_path(spark, "features")
    storage.save_panel_json(T.supplier_year_panel(spark, sf), path)
    records, _years, missing = storage.load_features(spark, path, expected=(1990, 2000))
    return _round_all(records.unionByName(missing, allowMissingColumns=True), set(T.SUPPLIER_FEATURES))


@query("summary_csv_roundtrip", f"""
SELECT variable, count(value) AS count, {Q.r6('avg(value)')} AS mean, {Q.r6('stddev_pop(value)')} AS std,
  {Q.r6('min(value)')} AS min, {Q.r6('max(value)')} AS max
FROM ({Q.SUPPLIER_PANEL}) WHERE value IS NOT NULL GROUP BY variable""")
def q_summary_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    storage.save_csv(SS.summary_stats(T.supplier_year_panel(spark, sf)), path)
    back = storage.load_csv(spark, path, "variable STRING, count BIGINT, mean DOUBLE, std DOUBLE, "
                                         "min DOUBLE, max DOUBLE")
    return _round_all(back, {"mean", "std", "min", "max"})


@query("panel_clusters", None)
def q_panel_clusters(spark, sf):
    out = run_flow(spark, _acs_tree(spark, sf), cluster="kmeans", variables=T1 + T2,
                       file_glob="*.txt", k=4, pca_k=3)
    return out["profile"]


# Same result as the batch scan, so the same oracle.
query("acs_stream_ingest", REGISTRY["acs_scan"][1])(q_acs_stream_ingest)
