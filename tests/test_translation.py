"""The resumable map: what was kept isn't asked for again, whenever a run stopped."""

import json
import time
import uuid

import pytest

from loomline.operators import exchange
from loomline.streaming import translation

BLOCKS = "book string, i int, tag string, text string"


def blocks(spark, n=60, books=("k", "m")):
    return spark.createDataFrame([(b, i, "p", f"{b}{i}") for b in books for i in range(n)], BLOCKS)


def noting(folder, stop=None):
    """A provider that notes what it is asked for, and fails for good at the text `stop` while the folder has no file go."""

    def provider(texts):
        if stop in texts and not (folder / "go").exists():
            raise RuntimeError("killed")
        (folder / f"{uuid.uuid4().hex}.asked").write_text("\n".join(texts))
        return json.dumps([f"[{t}]" for t in texts])

    return provider


def asked(folder):
    return [t for f in folder.glob("*.asked") for t in f.read_text().split("\n")]


def test_a_stopped_stream_goes_on_where_it_stopped(spark, tmp_path):
    notes, source = tmp_path / "notes", str(tmp_path / "source")
    notes.mkdir()
    for part in range(4):
        blocks(spark).where(f"i div 15 = {part}").coalesce(1).write.mode("append").parquet(source)
    provider = noting(notes, stop="k22")
    start = lambda: translation.stream(spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", 1).parquet(source), provider, str(tmp_path / "cache"), str(tmp_path / "state"), batch=5)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    before = translation.read_cache(spark, str(tmp_path / "cache"))
    assert before.count() == 30  # the first file's; the second one's batch was lost
    kept = asked(notes)
    assert len(set(kept) & {f"{b}{i}" for b in "km" for i in range(15)}) == 30
    (notes / "go").write_text("")
    start().awaitTermination()
    cache = translation.read_cache(spark, str(tmp_path / "cache"))
    assert {(r["book"], r["i"]): r["text"] for r in cache.collect()} == {(b, i): f"[{b}{i}]" for b in "km" for i in range(60)}
    again = asked(notes)
    assert all(again.count(t) == 1 for t in kept if int(t[1:]) < 15 or int(t[1:]) >= 30)
    n = len(again)
    start().awaitTermination()  # nothing is left to ask for
    assert len(asked(notes)) == n
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 120


def test_rounds_are_kept_one_by_one(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    path = str(tmp_path / "cache")
    with pytest.raises(Exception, match="killed"):
        translation.resume(blocks(spark), noting(notes, stop="m41"), path, rounds=6, batch=5)
    had = {(r["book"], r["i"]) for r in translation.read_cache(spark, path).collect()}
    first = asked(notes)
    (notes / "go").write_text("")
    assert translation.resume(blocks(spark), noting(notes), path, rounds=6, batch=5).count() == 120
    later = asked(notes)[:]
    assert all(later.count(f"{b}{i}") == 1 for b, i in had) and len(had) < 120 and len(later) >= len(first)


def test_a_cache_that_cannot_be_read_is_empty(spark, tmp_path):
    assert translation.read_cache(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "cache" / "run=x" / "batch=0"
    blocks(spark, 3).select("book", "i", "text").coalesce(1).write.parquet(str(path))
    (path / "part-broken.parquet").write_bytes(b"no parquet")
    assert translation.read_cache(spark, str(tmp_path / "cache")).count() == 6
    files = spark.createDataFrame([("a", '{"0": "x", "12": "y", "z": "no number"}'), ("b", "{broken"), ("c", None), ("d", "[1]")], "book string, json string")
    assert sorted(map(tuple, translation.read_json_cache(files).collect())) == [("a", 0, "x"), ("a", 12, "y")]
    cache = translation.read_json_cache(files)
    assert translation.read_json_cache(translation.json_cache(cache)).orderBy("i").collect() == cache.orderBy("i").collect()


def test_what_failed_is_asked_for_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    flaky = lambda texts: json.dumps(texts) if "k3" not in texts else "?"
    assert translation.resume(blocks(spark, 8, ("k",)), flaky, path, batch=4, retries=1, pause=lambda s: None).count() == 7
    assert translation.resume(blocks(spark, 8, ("k",)), lambda texts: json.dumps(texts), path, first=1).count() == 8


def test_pauses_double_up_to_eight_seconds():
    waits = []
    assert exchange.translate_batch(["a", "b"], lambda texts: "?" if len(texts) > 1 else json.dumps(texts), retries=6, pause=waits.append) == ["a", "b"]
    assert waits == [1, 2, 4, 8, 8, 8]


def test_requests_under_way_are_bounded_and_counted(spark):
    progress = spark.sparkContext.accumulator(0)

    def slow(texts):
        begun = time.time()
        time.sleep(0.1)
        return json.dumps([f"{begun} {time.time()}" for _ in texts])

    own = blocks(spark, 9, ("k",))
    spans = [tuple(map(float, r["text"].split())) for r in exchange.translate(own, slow, batch=1, at_once=3, progress=progress).coalesce(1).collect()]
    at_once = [sum(b <= begun < e for b, e in spans) for begun, _ in spans]
    assert 2 <= max(at_once) <= 3 and progress.value == 9
