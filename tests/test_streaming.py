"""Streaming ingest gives the batch scan's result, across two arrivals."""

from panelkit.session import scratch_path
from panelkit.sources import acs
from panelkit.streaming.ingest import read_ingested, start_acs_ingest

from tests.test_acs_ingest import FILES


def _write(root, names):
    for rel in names:
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(FILES[rel], encoding="utf-8")


def _rows(df):
    return sorted((r.geo_id, r.year or 0, r.variable, r.value if r.value is not None else float("nan"))
                  for r in df.collect())


def test_stream_matches_batch(spark, tmp_path):
    watch = tmp_path / "in"
    first = [k for k in FILES if k.startswith("T1/")]
    later = [k for k in FILES if k.startswith(("T2/", "T3/"))]
    log, ck = scratch_path(spark, "t-log"), scratch_path(spark, "t-ck")
    _write(watch, first)
    q = start_acs_ingest(spark, str(watch), log, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    _write(watch, later)
    q = start_acs_ingest(spark, str(watch), log, checkpoint_location=ck, available_now=True)
    q.awaitTermination(120)
    assert str(_rows(read_ingested(spark, log))) == str(_rows(acs.scan_acs(spark, str(watch))))
