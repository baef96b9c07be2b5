"""SQL twins of the derived panels and column rules, for the DuckDB oracle.

They are generated from the same constants the Spark code uses (feature
lists, FIPS table), so both sides describe one computation.
"""

from __future__ import annotations

from panelkit.schema import FIPS_STATES, REGION_FIPS
from panelkit.sources.tables import FIPS_CODES

SUPPLIER_WIDE = """SELECT CAST(l_suppkey AS VARCHAR) AS geo_id, CAST(year(l_shipdate) AS INTEGER) AS year,
  sum(round(l_quantity * 100.0)) / count(*) / 100.0 AS avg_qty,
  sum(round(l_extendedprice * 100.0)) / count(*) / 100.0 AS avg_price,
  sum(round(l_discount * 100.0)) / count(*) / 100.0 AS avg_disc,
  sum(round(l_tax * 100.0)) / count(*) / 100.0 AS avg_tax, CAST(count(*) AS DOUBLE) AS n_lines
  FROM lineitem GROUP BY 1, 2"""

SUPPLIER_PANEL = f"""SELECT geo_id, year, variable, value FROM ({SUPPLIER_WIDE}) w
  UNPIVOT INCLUDE NULLS (value FOR variable IN (avg_qty, avg_price, avg_disc, avg_tax, n_lines))"""

CUSTOMER_WIDE = """SELECT CAST(o_custkey AS VARCHAR) AS geo_id, CAST(year(o_orderdate) AS INTEGER) AS year,
  sum(round(o_totalprice * 100.0)) / 100.0 AS sum_price,
  sum(round(o_totalprice * 100.0)) / count(*) / 100.0 AS avg_price, CAST(count(*) AS DOUBLE) AS n_orders
  FROM orders GROUP BY 1, 2"""

CUSTOMER_PANEL = f"""SELECT geo_id, year, variable, value FROM ({CUSTOMER_WIDE}) w
  UNPIVOT INCLUDE NULLS (value FOR variable IN (sum_price, avg_price, n_orders))"""

USER_DAY_PANEL = """SELECT geo_id, year, variable, value FROM (SELECT CAST(user_id AS VARCHAR) AS geo_id,
      CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS year,
      sum(value) AS sum_value, CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY 1, 2) w
  UNPIVOT INCLUDE NULLS (value FOR variable IN (sum_value, n_events))"""

LINE_PANEL = """SELECT geo_id, year, variable, value FROM
  (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS geo_id,
      CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS qty, l_extendedprice AS price,
      l_discount AS disc, l_tax AS tax FROM lineitem) w
  UNPIVOT INCLUDE NULLS (value FOR variable IN (qty, price, disc, tax))"""

BALANCE_ROWS = """SELECT CAST(c_custkey AS VARCHAR) AS geo_id, CAST(1995 + c_nationkey % 7 AS INTEGER) AS year,
  'acctbal' AS variable, c_acctbal AS value FROM customer"""


def fips_pick_sql(key: str) -> str:
    codes = ", ".join(f"'{c}'" for c in FIPS_CODES)
    return f"([{codes}])[1 + ({key}) % {len(FIPS_CODES)}]"


GEO_IDS = f"""SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN ''
  ELSE CASE c_custkey % 6
    WHEN 0 THEN '1400000US' || {fips_pick_sql('c_custkey')} || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    WHEN 1 THEN '1400000US' || {fips_pick_sql('c_custkey')} || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
    WHEN 2 THEN '8600000US' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')
    WHEN 3 THEN 'ZCTA5 ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')
    WHEN 4 THEN '0500000US' || {fips_pick_sql('c_custkey')} || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
    ELSE '0400000US' || {fips_pick_sql('c_custkey')} END END AS "GEO_ID",
  CASE WHEN c_custkey % 22 = 0 THEN NULL ELSE c_name END AS "NAME"
  FROM customer"""

RAW_CELLS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE (l_orderkey + l_linenumber) % 10
    WHEN 0 THEN format('{:,}', l_orderkey * 10 + l_linenumber)
    WHEN 1 THEN CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '+'
    WHEN 2 THEN format('{:,}', l_orderkey * 10 + l_linenumber) || '-'
    WHEN 3 THEN 'null' WHEN 4 THEN '(X)' WHEN 5 THEN '-'
    WHEN 6 THEN '"' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '"'
    WHEN 7 THEN CAST(l_linenumber AS VARCHAR) || 'e2'
    WHEN 8 THEN '  ' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || ' '
    ELSE '-' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '-' END AS cell
  FROM lineitem"""

NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalise_sql(c: str) -> str:
    s = f"trim(trim({c}, '\"'))"
    cleaned = f"trim(replace(regexp_replace({s}, '[+-]+$', ''), ',', ''))"
    num = (f"CASE WHEN regexp_matches({cleaned}, '{NUMBER_RE}') "
           f"THEN TRY_CAST({cleaned} AS DOUBLE) END")
    return (f"CASE WHEN {c} IS NULL OR {s} IN ('-', 'null', '') THEN NULL "
            f"WHEN suffix({s}, '-') THEN -({num}) ELSE {num} END")


def valid_sql(c: str) -> str:
    s = f"trim({c})"
    body = f"trim(replace(replace({s}, ',', ''), '+', ''))"
    return (f"CASE WHEN {c} IS NULL THEN false WHEN {s} IN ('-', '', 'null', 'N/A') THEN false "
            f"ELSE regexp_matches({body}, '{NUMBER_RE}') END")


def clean_text_sql(c: str) -> str:
    s = f"trim(trim({c}, '\"'))"
    return f"CASE WHEN {s} IN ('-', 'null', '') THEN NULL ELSE {s} END"


def _case_map(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def state_sql(g: str) -> str:
    slice_ = (f"CASE WHEN length({g}) >= 5 THEN substr({g}, length({g}) - 4, 2) "
              f"ELSE substr({g}, 1, greatest(length({g}) - 3, 0)) END")
    code = (f"CASE WHEN starts_with({g}, '1400000US') OR starts_with({g}, '8600000US') "
            f"THEN substr({g}, 10, 2) ELSE {slice_} END")
    return (f"CASE WHEN {g} IS NULL THEN NULL WHEN starts_with({g}, 'ZCTA5') THEN 'ZCTA' "
            f"ELSE coalesce({_case_map(code, FIPS_STATES)}, 'Unknown') END")


def region_sql(g: str) -> str:
    region_by_code = {code: region for region, codes in REGION_FIPS.items() for code in codes}
    return (f"CASE WHEN {g} IS NULL THEN NULL "
            f"WHEN starts_with({g}, '1400000US') AND length({g}) = 20 "
            f"THEN coalesce({_case_map(f'substr({g}, 10, 2)', region_by_code)}, 'Unknown') "
            f"ELSE 'Unknown' END")


def winsor_sql(panel: str, keys: str = "year, variable", lower: float = 0.05, upper: float = 0.05) -> str:
    """Rows of ``panel`` (non-null values) with n, rn, mean, std, low, high."""
    return f"""(SELECT *, max(CASE WHEN rn = floor({lower} * n) + 1 THEN value END) OVER (PARTITION BY {keys}) AS low,
       max(CASE WHEN rn = n - floor({upper} * n) THEN value END) OVER (PARTITION BY {keys}) AS high
     FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS rn,
             count(*) OVER (PARTITION BY {keys}) AS n,
             avg(value) OVER (PARTITION BY {keys}) AS mean,
             stddev_pop(value) OVER (PARTITION BY {keys}) AS std
           FROM ({panel}) WHERE value IS NOT NULL))"""


def r6(x: str) -> str:
    """Same rounding as the Spark side: floor(x * 1e6 + 0.5) / 1e6 in IEEE
    doubles (engines' own round() differ on ties)."""
    return f"(floor(({x}) * 1000000.0 + 0.5) / 1000000.0)"


def rnd(x: str, digits: int) -> str:
    scale = f"{10.0 ** digits:.1f}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    """NumPy-style bin index, same arithmetic as the Spark expression."""
    step = f"(({hi}) - ({lo})) / {float(bins)}"
    raw = (f"least(greatest(CAST(floor((({x}) - ({lo})) * ({float(bins)} / (({hi}) - ({lo})))) AS INTEGER), 0), "
           f"{bins - 1})")

    def edge(i):
        return f"(CASE WHEN ({i}) >= {bins} THEN ({hi}) ELSE CAST({i} AS DOUBLE) * {step} + ({lo}) END)"
    down = f"(CASE WHEN ({x}) < {edge(raw)} THEN 1 ELSE 0 END)"
    up = f"(CASE WHEN ({x}) >= {edge(f'{raw} + 1')} AND {raw} <> {bins - 1} THEN 1 ELSE 0 END)"
    return f"least(greatest({raw} - {down} + {up}, 0), {bins - 1})"


def histogram_sql(data: str, keys: list[str], bins: int, range_keys: list[str] | None = None) -> str:
    """Histogram with empty bins over ``data`` (columns keys..., value)."""
    range_keys = range_keys or keys
    rk = ", ".join(range_keys)
    k = ", ".join(keys)
    join_r = " AND ".join(f"d.{c} = r.{c}" for c in range_keys)
    join_g = " AND ".join(f"g.{c} = r.{c}" for c in range_keys)
    join_c = " AND ".join(f"g.{c} = c.{c}" for c in keys)
    step = f"((g.hi - g.lo) / {float(bins)})"
    return f"""WITH d AS (SELECT {k}, value FROM ({data}) WHERE value IS NOT NULL),
r AS (SELECT {rk}, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
        CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
      FROM d GROUP BY {rk}),
c AS (SELECT {", ".join('d.' + c for c in keys)}, {bin_sql('d.value', 'r.lo', 'r.hi', bins)} AS bin, count(*) AS count
      FROM d JOIN r ON {join_r} GROUP BY ALL),
g AS (SELECT {", ".join('g0.' + c for c in keys)}, r.lo, r.hi, CAST(b.range AS INTEGER) AS bin
      FROM (SELECT DISTINCT {k} FROM d) g0 JOIN r ON {" AND ".join(f"g0.{c} = r.{c}" for c in range_keys)}
      CROSS JOIN range(0, {bins}) b)
SELECT {", ".join('g.' + c for c in keys)}, g.bin, {r6(f'CAST(g.bin AS DOUBLE) * {step} + g.lo')} AS edge_lo,
  {r6(f'CASE WHEN g.bin = {bins - 1} THEN g.hi ELSE CAST(g.bin + 1 AS DOUBLE) * {step} + g.lo END')} AS edge_hi,
  CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON {join_c} AND g.bin = c.bin"""
