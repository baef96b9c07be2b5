"""ACS "detailed table" CSV trees: scan (and a writer for derived trees).

Layout: ``<root>/<table folder>/**/<file>``, one file per table and vintage,
the vintage in the path (``ACSDT5Y<yyyy>``).  In a file, record 1 is the
header (``GEO_ID``, ``NAME``, ``<var>``, ``<var>M`` ...), record 2 a label
row (skipped by position), the rest data.  Headers differ between files.

Scan plan (no Python on the data path):

* one CSV scan of every matching file below a table folder, all cells as
  STRING into a fixed width ``W`` (an upper bound on the fields of any line,
  from a cheap text pass that also detects quoted fields spanning lines);
  files are split like text files unless such a field exists (then each
  file is one ``multiLine`` split);
* position of a row in its file = rows of the file's earlier splits (a
  running sum over a per-split table) + its rank inside its split; row 1 is
  the header, row 2 the label row;
* a per-file header table (one row per file): the positions of the wanted
  variables (blank names and margin-of-error columns ``*M`` dropped);
* data rows explode only those positions; cells are normalised by Column
  expressions; the geography key is GEO_ID, else NAME; rows without either
  are skipped;
* one merge per (geo_id, year, variable): the value of the last cell in
  (path, row, column) order wins, also when that value is null.

Spark's CSV reader skips blank lines (the original counted them) and reads an
unquoted empty field as null: a null cell followed by a non-null one counts as
present-and-empty, trailing null cells as absent.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.cells import ACS_YEAR_PATTERN, clean_text, normalise_cell, year_from_path
from panelkit.functions.geo import region_of, state_of
from panelkit.operators.common import bounded_collect, materialise, small_side
from panelkit.schema import GEO, VALUE, VARIABLE, YEAR
from panelkit.session import scratch_path

STATIC_FIELDS = ("GEO_ID", "NAME", "region", "state", "year")
MAX_WHOLE_FILES = 10_000
MAX_BROADCAST_NAMES = 500_000
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?"


def _strip_scheme(c):
    return F.regexp_replace(c, _SCHEME, "")


def _root_key(root: str) -> str:
    import re
    return re.sub(_SCHEME, "", root).rstrip("/")


def _reader(spark: SparkSession, file_glob: str):
    return (spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", file_glob))


def _fields(line):
    """The fields of a CSV line that holds whole quoted fields; an empty unquoted field is null."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*),'), F.lit(1))
    return F.transform(found, lambda x: F.when(x == "", F.lit(None).cast("string"))
                       .when(x.startswith('"') & x.endswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"')))
                       .otherwise(x))


def _read_whole(spark: SparkSession, paths: list[str], at: list) -> DataFrame:
    """Cells of files whose quoted fields span lines, up to each record's last filled one."""
    width = spark.read.text(paths).agg(F.max(F.size(F.split("value", ",", -1)))).first()[0]
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    cells = F.array(*[F.col(f"_c{i}") for i in range(width)])
    gap = F.array_position(F.transform(F.reverse(cells), lambda c: c.isNotNull()), F.lit(True))
    return (spark.read.schema(schema).option("header", False).option("multiLine", True).option("escape", '"')
            .option("mode", "PERMISSIVE").csv(paths)
            .select(*at, F.when(gap > 0, F.slice(cells, 1, (width - gap + 1).cast("int"))).otherwise(F.array().cast("array<string>")).alias("cells")))


def scan_cells(spark: SparkSession, root: str, variables=None, file_glob: str = "*-Data.csv",
               year_pattern: str = ACS_YEAR_PATTERN, paths: list[str] | None = None,
               rows_only: bool = False, multi_line: bool | None = None) -> DataFrame:
    """Long cells ``(geo_id, name, year, variable, cell, src_path, src_blk,
    src_pos, src_col)`` of all data rows, before normalising and merging.
    With ``paths`` only those files (below ``root``) are read; with
    ``rows_only`` one row per keyed data row.

    A file without a line that holds an odd number of quotes (no quoted field
    spans lines) is read line by line and split like any text file, so one
    huge file is read by many tasks; every record keeps its own number of
    fields, trailing empty ones and blank lines included.  Only the other
    files are read whole, one task each (``multiLine``; there, trailing empty
    fields and blank lines cannot be told).  ``multi_line`` forces one of the
    two for all files.  The scan runs once: everything below works on its
    stored copy, so a change of the cluster between steps cannot change it."""
    root_key = _root_key(root)
    source = paths if paths else root
    at = [F.col("_metadata.file_path").alias("src_path"), F.col("_metadata.file_block_start").alias("src_blk")]
    lines = _reader(spark, file_glob).text(source).select(*at, F.col("value").alias("line"))
    odd = F.size(F.split("line", '"', -1)) % 2 == 0
    if multi_line is None:
        whole = [r[0] for r in bounded_collect(lines.where(odd).select("src_path").distinct(), MAX_WHOLE_FILES,
                                               "files with quoted fields that span lines")]
    else:
        whole = [r[0] for r in bounded_collect(lines.select("src_path").distinct(), MAX_WHOLE_FILES,
                                               "files read whole")] if multi_line else []
    raw = lines.where(~F.col("src_path").isin(whole)) if whole else lines
    raw = raw.select("src_path", "src_blk", _fields(F.col("line")).alias("cells"))
    if whole:
        raw = raw.unionByName(_read_whole(spark, [unquote(p) for p in whole], at))
    # Only files inside a table folder: their parent is not the root itself.
    parent = F.regexp_extract(_strip_scheme(F.col("src_path")), r"^(.*)/[^/]+$", 1)
    raw = raw.where(parent != F.lit(root_key)).withColumn("_rid", F.monotonically_increasing_id())
    copy = scratch_path(spark, "acs-scan")
    raw.write.parquet(copy)
    raw = spark.read.schema(raw.schema).parquet(copy)

    # Position in the file: rows before this split (running sum over the
    # file's splits, one row per split) + position inside the split.
    splits = raw.groupBy("src_path", "src_blk").agg(F.min("_rid").alias("_first"),
                                                   F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("src_path").orderBy("src_blk")
                              .rowsBetween(Window.unboundedPreceding, -1))
    splits = small_side(splits.select("src_path", "src_blk", "_first",
                                      F.coalesce(before, F.lit(0)).alias("_before")))
    rows = (raw.join(splits, ["src_path", "src_blk"])
            .withColumn("src_pos", F.col("_before") + F.col("_rid") - F.col("_first") + 1)
            .drop("_rid", "_first", "_before"))

    # Header table: one row per file, positions of the wanted variables.
    h = F.transform(F.col("cells"), lambda c: F.btrim(F.regexp_replace(c, "^\ufeff", ""), F.lit('"')))
    headers = rows.where(F.col("src_pos") == 1).select("src_path", h.alias("header"))
    idx = F.sequence(F.lit(1), F.size("header"))
    entries = F.transform(idx, lambda i: F.struct(F.element_at("header", i).alias("name"), i.alias("i")))

    def wanted(e):
        name = e["name"]
        ok = (name.isNotNull() & (F.trim(name) != "") & ~name.endswith("M")
              & ~name.isin(*STATIC_FIELDS))
        if variables is not None:
            ok = ok & name.isin(*list(variables))
        return ok

    headers = headers.select(
        "src_path", F.size("header").alias("_hw"),
        F.array_position("header", "GEO_ID").cast("int").alias("_gi"),
        F.array_position("header", "NAME").cast("int").alias("_ni"),
        F.filter(entries, wanted).alias("_sel"))
    headers = materialise(headers)
    held = headers.agg(F.sum(F.size("_sel"))).first()[0] or 0  # names that a broadcast would carry
    if held <= MAX_BROADCAST_NAMES:
        headers = F.broadcast(headers)

    data = rows.where(F.col("src_pos") >= 3).join(headers, "src_path")
    # Cells up to the header's width; a record has as many as it was written with.
    cut = F.slice("cells", 1, F.col("_hw"))
    data = data.select("src_path", "src_blk", "src_pos", "_sel", cut.alias("_cells"), F.size(cut).alias("_len"),
                       F.get(cut, F.col("_gi") - 1).alias("_geo"), F.get(cut, F.col("_ni") - 1).alias("_name"))
    key = F.coalesce(clean_text("_geo"), clean_text("_name"))
    data = (data.withColumn(GEO, key).where(F.col(GEO).isNotNull())
            .withColumn("name", clean_text("_name"))
            .withColumn(YEAR, year_from_path("src_path", year_pattern)))
    if rows_only:
        return data.select(GEO, "name", YEAR, "src_path", "src_blk", "src_pos")
    return (data.select(GEO, "name", YEAR, "src_path", "src_blk", "src_pos", "_cells", "_len",
                        F.explode("_sel").alias("_e"))
            .where(F.col("_e.i") <= F.col("_len"))
            .select(GEO, "name", YEAR, F.col("_e.name").alias(VARIABLE),
                    F.get("_cells", F.col("_e.i") - 1).alias("cell"),
                    "src_path", "src_blk", "src_pos", F.col("_e.i").alias("src_col")))


def observations(cells: DataFrame, null_sentinels=()) -> DataFrame:
    """Merged long table ``(geo_id, year, variable, value)``: last cell wins."""
    order = F.struct("src_path", "src_pos", "src_col")
    return (cells.withColumn(VALUE, normalise_cell("cell", tuple(null_sentinels)))
            .groupBy(GEO, YEAR, VARIABLE).agg(F.max_by(VALUE, order).alias(VALUE)))


def geo_dim(spark: SparkSession, root: str, file_glob: str = "*-Data.csv") -> DataFrame:
    """``(geo_id, year, name, state, region)`` per geography and vintage;
    NAME of the last row wins."""
    rows = scan_cells(spark, root, [], file_glob, rows_only=True)
    g = rows.groupBy(GEO, YEAR).agg(F.max_by("name", F.struct("src_path", "src_pos")).alias("name"))
    return g.select(GEO, YEAR, "name", state_of(F.col(GEO)).alias("state"), region_of(F.col(GEO)).alias("region"))


def scan_acs(spark: SparkSession, root: str, variables=None, file_glob: str = "*-Data.csv",
             null_sentinels=(), multi_line: bool | None = None) -> DataFrame:
    return observations(scan_cells(spark, root, variables, file_glob, multi_line=multi_line), null_sentinels)


# --------------------------------------------------------------------------- writer
def write_acs_tree(root: str, tables: dict) -> None:
    """Write an ACS-shaped tree.  ``tables`` maps a table name to
    ``(variables, lines)`` where ``lines`` has ``(year, ord, line)`` data
    lines already in CSV form.  Each file gets a header (``GEO_ID``, ``NAME``,
    ``<var>``, ``<var>M`` ..., and a trailing blank column) and a label row;
    files go to ``<root>/tbl=<table>/vintage=ACSDT5Y<year>/part-*.txt``, one
    per table and vintage, rows in ``ord`` order."""
    out = None
    for tname, (variables, lines) in tables.items():
        names = ["GEO_ID", "NAME"] + [c for v in variables for c in (v, f"{v}M")]
        labels = ["id", "Geographic Area Name"] + [c for v in variables
                                                    for c in (f"Estimate!!{v}", f"Margin of Error!!{v}")]
        years = lines.select(YEAR).distinct()
        header = years.select(YEAR, F.lit(-2).cast("long").alias("ord"),
                              F.lit(",".join(f'"{n}"' for n in names) + ",").alias("line"))
        label = years.select(YEAR, F.lit(-1).cast("long").alias("ord"),
                             F.lit(",".join(f'"{n}"' for n in labels) + ",").alias("line"))
        part = (header.unionByName(label).unionByName(lines.select(YEAR, F.col("ord").cast("long"), "line"))
                .withColumn("tbl", F.lit(tname)))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("vintage", F.concat(F.lit("ACSDT5Y"), F.col(YEAR).cast("string")))
    (out.repartition("tbl", "vintage").sortWithinPartitions("tbl", "vintage", "ord")
     .select("tbl", "vintage", "line").write.mode("overwrite").partitionBy("tbl", "vintage").text(root))


def quote(c):
    """A CSV-quoted text cell."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
