"""Sessions: what each accepts, over a table and over a stream whose events come out of order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators.dealing import in_sequence
from loomline.streaming import buckets, sessions

EVENTS = "session string, at double, id long, kind string, token string, bytes long"


def of(spark, rows, limits):
    df = spark.createDataFrame(rows, EVENTS)
    return {r["id"]: r["accepted"] for r in sessions.decisions(df, limits).collect()}


def test_a_file_that_is_refused_takes_no_room(spark):
    files = spark.createDataFrame([("a", 1, 10), ("a", 2, 500), ("a", 3, 20), ("b", 1, None), ("b", 2, 100), ("b", 3, 1)], "session string, seq int, bytes long").withColumn("accepted_by", F.lit("x"))
    got = {(r["session"], r["seq"]): r["accepted"] for r in buckets.quota(files, max_bytes=100).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): True, ("b", 2): True, ("b", 3): False}
    capped = buckets.quota(files.where("session = 'a'"), max_files=1).where("accepted").collect()
    assert [r["seq"] for r in capped] == [1]
    assert buckets.quota(files.where("false")).count() == 0


def test_a_session_has_only_its_own_files(spark):
    rows = [("a", 0.0, 1, "open", None, None), ("b", 0.0, 2, "open", None, None), ("a", 1.0, 3, "add", "t", 10), ("a", 2.0, 4, "fetch", "t", None), ("b", 2.0, 5, "fetch", "t", None), ("c", 2.0, 6, "fetch", "t", None), (None, 2.0, 7, "open", None, None)]
    assert of(spark, rows, sessions.Limits()) == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_a_session_ends_with_its_time_to_live(spark):
    rows = [("a", 0.0, 1, "open", None, None), ("a", 10.0, 2, "touch", None, None), ("a", 20.0, 3, "add", "t", 1), ("a", 20.5, 4, "fetch", "t", None), ("a", 30.6, 5, "fetch", "t", None), ("a", 31.0, 6, "touch", None, None), ("a", 32.0, 7, "open", None, None), ("a", 33.0, 8, "fetch", "t", None)]
    # adding keeps no session alive; a session that is opened anew has no files
    assert of(spark, rows, sessions.Limits(ttl=10)) == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}
    assert of(spark, rows, sessions.Limits(ttl=10.5)) == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_batches_carry_the_state_on(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 as k", "id as i")
        got = in_sequence(df, ["k"], ["i"], lambda n, row: ((n or 0) + 1, ((n or 0) + 1,)), "nth int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["nth"] == r["i"] // 3 + 1 for r in got) and len(got) == 100


@pytest.fixture
def state_store(spark):
    before = {k: spark.conf.get(k) for k in sessions.STATE_STORE}
    for k, v in sessions.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stream_and_table_decide_alike(spark, tmp_path, state_store):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), k * 7.0 + draw.random(), k, draw.choice(["open", "touch", "add", "add", "fetch", "odd"]), draw.choice(["t1", "t2", None]), draw.choice([1, 50, None])) for k in range(150)]
    limits = sessions.Limits(ttl=40.0, max_files=3, max_bytes=100)
    want = {r["id"]: tuple(r) for r in sessions.decisions(spark.createDataFrame(rows, EVENTS), limits).collect()}
    assert {w[6] for w in want.values()} == {True, False}
    come = sorted(rows, key=lambda r: r[1] + draw.random() * 100) + [("end", 1e6, 10**6, "open", None, None)]
    source = tmp_path / "events"
    source.mkdir()
    names = [f.split()[0] for f in EVENTS.split(", ")]

    def feed(part):
        lines = "\n".join(json.dumps(dict(zip(names, r))) for r in come[part * 40 : part * 40 + 40])
        (source / f"{part}.json").write_text(lines)

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
        out = sessions.decisions_stream(stream, limits, "200 seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    # the state outlives a query that stops and is started again
    feed(0), feed(1)
    run()
    feed(2), feed(3)
    run()
    got = {r["id"]: tuple(r[c] for c in ("session", *sessions.FIELDS, "accepted", "files", "used")) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    got.pop(10**6, None)
    assert got == want
