"""ACS CSV tree scan on generated files (FIXTURES §3)."""


import pytest

from panelkit.sources import acs

FILES = {
    "T1/2019/ACSDT5Y2019.T1-Data.csv":
        '"GEO_ID","NAME","B01_001E","B01_001M","B02_001E",\n'
        '"Geography","Geographic Area Name","Estimate!!Total","Margin","Estimate!!Other",\n'
        '"1400000US06037101110","Tract 1, Los Angeles","2,500-","**","17",\n'
        '"1400000US36061000100","Tract 2, New York","250,000+","12","(X)",\n',
    "T1/2020/ACSDT5Y2020.T1-Data.csv":
        '\ufeff"GEO_ID","NAME","B01_001E","B03_001E"\n'
        '"Geography","Name","Total","New"\n'
        '"1400000US06037101110","Tract 1, Los Angeles","3000","5"\n'
        '"1400000US36061000100","Tract 2, New York","7"\n'
        '"8600000US46204","ZIP 46204","1","2","99","98"\n',
    "T2/2019/ACSDT5Y2019.T2-Data.csv":
        'GEO_ID,NAME,C01_001E\nGeography,Name,Total\n'
        '1400000US06037101110,"Tract 1, Los Angeles",11\n',
    "T2/2020/ACSDT5Y2020.T2-Data.csv":
        'GEO_ID,NAME,C01_001E,C02_001E\nGeography,Name,Total,Other\n'
        '1400000US06037101110,Tract 1,21,1\n'
        '1400000US06037101110,Tract 1 (later),-,2\n',
    "T2/2021/ACSDT5Y2021.T2-Data.csv":
        'GEO_ID,NAME,C01_001E\nGeography,Name,Total\n'
        ',Only A Name,4\n'
        ',,5\n'
        'null,-,6\n',
    "T3/empty-Data.csv": "",
    "T3/one-line-Data.csv": 'GEO_ID,NAME,X_E\n',
    "T3/no-year-Data.csv": 'GEO_ID,NAME,X_E\nGeography,Name,Total\nZCTA5 46204,Zip,8\n',
    "root-Data.csv": 'GEO_ID,NAME,B01_001E\nG,N,T\n1400000US06037101110,Root,999\n',
    "T1/notes.txt": "not a data file\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("acs")
    for rel, text in FILES.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(root)


def test_observations(spark, tree):
    obs = {(r.geo_id, r.year, r.variable): r.value for r in acs.scan_acs(spark, tree).collect()}
    la, ny = "1400000US06037101110", "1400000US36061000100"
    assert obs[(la, 2019, "B01_001E")] == -2500.0
    assert obs[(ny, 2019, "B01_001E")] == 250000.0
    assert obs[(ny, 2019, "B02_001E")] is None          # "(X)"
    assert obs[(la, 2020, "B01_001E")] == 3000.0        # BOM before a quoted header
    assert obs[(la, 2020, "B03_001E")] == 5.0
    assert (ny, 2020, "B03_001E") not in obs            # short row: field absent
    assert obs[("8600000US46204", 2020, "B03_001E")] == 2.0   # long row cut to the header
    assert obs[(la, 2019, "C01_001E")] == 11.0          # second table merged in
    assert obs[(la, 2020, "C01_001E")] is None          # later duplicate with "-" wins
    assert obs[(la, 2020, "C02_001E")] == 2.0
    assert obs[("Only A Name", 2021, "C01_001E")] == 4.0  # NAME fallback
    assert obs[("ZCTA5 46204", None, "X_E")] == 8.0     # no vintage in the path
    assert not any(k[2].endswith("M") for k in obs)     # margins of error dropped
    assert not any(v == 999.0 for v in obs.values())    # file directly under the root not read
    assert len([k for k in obs if k[1] == 2021]) == 1   # rows without both keys skipped


def test_variable_selection_and_geo_dim(spark, tree):
    obs = acs.scan_acs(spark, tree, variables=["C01_001E"]).collect()
    assert {r.variable for r in obs} == {"C01_001E"}
    dim = {(r.geo_id, r.year): (r.name, r.state, r.region) for r in acs.geo_dim(spark, tree).collect()}
    assert dim[("1400000US06037101110", 2020)] == ("Tract 1 (later)", "California", "West")
    assert dim[("ZCTA5 46204", None)] == ("Zip", "ZCTA", "Unknown")


def test_empty_tree(spark, tmp_path):
    d = tmp_path / "T9"
    d.mkdir()
    (d / "x-Data.csv").write_text("")
    assert acs.scan_acs(spark, str(tmp_path)).count() == 0


def test_geo_dim_keeps_rows_without_variables(spark, tmp_path):
    d = tmp_path / "T1" / "2019"
    d.mkdir(parents=True)
    (d / "ACSDT5Y2019.T1-Data.csv").write_text('GEO_ID,NAME\nGeography,Name\n1400000US06037101110,Only Names\n')
    dim = acs.geo_dim(spark, str(tmp_path)).collect()
    assert [(r.geo_id, r.year, r.name) for r in dim] == [("1400000US06037101110", 2019, "Only Names")]
    assert acs.scan_acs(spark, str(tmp_path)).count() == 0


def test_split_files_keep_file_order(spark, tree):
    """Tiny splits: every file is read by several tasks; results unchanged."""
    want = sorted(map(tuple, acs.scan_acs(spark, tree, multi_line=True).collect()), key=repr)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(map(tuple, acs.scan_acs(spark, tree, multi_line=False).collect()), key=repr)
        auto = sorted(map(tuple, acs.scan_acs(spark, tree).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and auto == want


def _write(tmp_path, lines, vintage=2020):
    folder = tmp_path / "T1" / f"ACSDT5Y{vintage}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "x-Data.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_trailing_empty_fields_are_nulls(spark, tmp_path):
    """The later row's empty last field overwrites; blank lines count as records; quotes and commas survive."""
    root = _write(tmp_path, ['"GEO_ID","NAME","V1","V2"', "id,name,a,b", "a,Aa,5,7", 'b,"B ""x"", b",1,2', "a,Aa,6,", "c,Cc,9,"])
    got = {(r.geo_id, r.variable): r.value for r in acs.scan_acs(spark, root).collect()}
    assert got == {("a", "V1"): 6.0, ("a", "V2"): None, ("b", "V1"): 1.0, ("b", "V2"): 2.0, ("c", "V1"): 9.0, ("c", "V2"): None}
    names = {r.geo_id: r.name for r in acs.geo_dim(spark, root).collect()}
    assert "b" in names and names["a"] == "Aa"


def test_blank_second_record_counts(spark, tmp_path):
    root = _write(tmp_path, ["GEO_ID,NAME,V1", "", "a,Aa,1", "b,Bb,2"])
    assert acs.scan_acs(spark, root).count() == 2


def test_rows_survive_other_split_sizes(spark, tmp_path):
    """Built under one split size, read under another: the same rows."""
    root = _write(tmp_path, ["GEO_ID,NAME,V1", "id,name,a", *[f"g{i},N{i},{i}" for i in range(20_000)]])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "100k")
        cells = acs.scan_cells(spark, root)
        spark.conf.set(key, "30k")
        assert cells.count() == 20_000
        assert cells.agg({"src_pos": "max"}).first()[0] == 20_002
    finally:
        spark.conf.set(key, before)
