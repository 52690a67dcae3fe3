"""Work under a tag is watched and stopped, and leaves nothing."""

import threading
import time

import pytest

from loomline.operators import jobs


def test_stopped_work_leaves_no_output(spark, tmp_path):
    def slow(frames):
        for f in frames:
            time.sleep(60 if f["id"].max() >= 50 else 0)
            yield f

    got: list = []

    def work():
        try:
            jobs.run(spark, "slow", lambda: spark.range(0, 100, 1, 4).mapInPandas(slow, "id long").write.parquet(str(tmp_path / "out")))
        except jobs.Stopped as e:
            got.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(300):
        seen = jobs.progress(spark, "slow")
        if seen.done >= 2:
            break
        time.sleep(0.1)
    assert (seen.jobs, seen.done, seen.running, seen.total) == (1, 2, 2, 4)
    begun = time.time()
    assert jobs.run(spark, "other", lambda: spark.range(10).count()) == 10  # others go on
    jobs.stop(spark, "other")
    assert thread.is_alive()
    jobs.stop(spark, "slow")
    thread.join(30)
    assert len(got) == 1 and time.time() - begun < 20 and not list((tmp_path / "out").glob("part-*")) and not (tmp_path / "out" / "_SUCCESS").exists()
    assert jobs.progress(spark, "slow") == jobs.Progress()


def test_other_errors_stay_what_they_are(spark):
    with pytest.raises(ZeroDivisionError):
        jobs.run(spark, "t", lambda: 1 / 0)
    with pytest.raises(Exception, match="mine"):
        jobs.run(spark, "t", lambda: spark.range(1).selectExpr("raise_error('mine')").collect())
