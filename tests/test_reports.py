"""Reports: saved, resolved and compacted, with a notice that goes out once."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.sources import reports

def now():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = [("r1", "merge", "cannot open '/x/My Book.epub'", "ann@x.example"), ("r2", "split", "plain", ""), ("r3", "merge", None, None)]
    requests = spark.createDataFrame(rows, "request string, endpoint string, error string, notify string").withColumn("at_ts", F.to_timestamp(F.lit("2024-02-03 04:05:06")))
    files = spark.createDataFrame([("r1", 5, "/up/My Book.epub", b"one"), ("r1", 9, "other.ZIP", b"two"), ("r2", 0, "no extension", b"three"), ("gone", 0, "x.epub", b"four")], "request string, position int, name string, content binary")
    ids = {r["request"]: r["id"] for r in reports.save(requests, path, 1, files).collect()}
    # saved again, as after a failure, it is the same
    assert ids == {r["request"]: r["id"] for r in reports.save(requests, path, 1, files).collect()} and len(ids) == 3
    return path, ids


def rows(spark, path):
    return {r["id"]: r for r in reports.current(spark, path).collect()}


def test_a_saved_report_names_no_file(spark, path):
    path, ids = path
    got = rows(spark, path)
    assert len(got) == 3 and all(i.startswith("20240203-040506-") for i in got)
    one = got[ids["r1"]]
    assert one["error"] == "cannot open '<file>'" and one["attached"] == ["input-1.epub", "input-2.ZIP"] and one["saved_at"] == "2024-02-03T04:05:06+00:00" and one["resolved_at"] is None
    assert got[ids["r2"]]["attached"] == ["input-1.epub"] and got[ids["r2"]]["notify"] is None and got[ids["r3"]]["attached"] == []
    with zipfile.ZipFile(f"{path}/attachments/{ids['r1']}.zip") as z:
        assert z.namelist() == ["input-1.epub", "input-2.ZIP"] and z.read("input-2.ZIP") == b"two"


def test_resolving_twice_tells_once(spark, path):
    path, ids = path
    asked = spark.createDataFrame([(ids["r1"], "fixed in 1.2"), (ids["r2"], "no bug"), ("nobody", "?")], "id string, resolution string")
    for _ in range(2):  # the same write again replaces itself
        got = {r["id"]: (r["status"], r["notified"]) for r in reports.resolve(asked, path, 2, now()).collect()}
        assert got == {ids["r1"]: ("resolved", True), ids["r2"]: ("resolved", False), "nobody": ("unknown_id", False)}
    again = {r["id"]: r["notified"] for r in reports.resolve(asked.withColumn("resolution", F.lit("x" * 3000)), path, 3, now()).collect()}
    assert not any(again.values())
    assert [tuple(r) for r in reports.outbox(spark, path).collect()] == [(ids["r1"], "ann@x.example", "fixed in 1.2", 2)]
    got = rows(spark, path)
    assert got[ids["r1"]]["notify"] is None and got[ids["r1"]]["resolution"] == "x" * 2000 and got[ids["r1"]]["resolved_at"] == "2024-03-01T00:00:00+00:00"
    assert [r["id"] for r in reports.current(spark, path).collect()][0] == ids["r3"]  # open ones first


def test_a_snapshot_says_what_the_log_said(spark, path):
    path, ids = path
    reports.resolve(spark.createDataFrame([(ids["r1"], "done")], "id string, resolution string"), path, reports.next_version(spark, path), now())
    before = rows(spark, path)
    assert reports.compact(spark, path) == 2 and rows(spark, path) == before
    assert "ann@x.example" not in str(spark.read.parquet(f"{path}/snapshot").collect())
    more = spark.createDataFrame([("r9", "merge", "late", "bo@x.example")], "request string, endpoint string, error string, notify string").withColumn("at_ts", now())
    new = reports.save(more, path, reports.next_version(spark, path)).first()["id"]
    assert set(rows(spark, path)) == {*before, new} and reports.compact(spark, path) == 3 and len(rows(spark, path)) == 4
    got = reports.resolve(spark.createDataFrame([(new, "ok")], "id string, resolution string"), path, reports.next_version(spark, path), now()).first()
    assert got[:] == (new, "resolved", True) and reports.outbox(spark, path).count() == 2


def test_nothing_was_reported_yet(spark, tmp_path):
    path = str(tmp_path / "none")
    assert reports.current(spark, path).count() == 0 and reports.outbox(spark, path).count() == 0 and reports.next_version(spark, path) == 1
    assert reports.resolve(spark.createDataFrame([("a", "b")], "id string, resolution string"), path, 1).first()["status"] == "unknown_id"
