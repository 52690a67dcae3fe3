"""Nulls, empty and long texts, ties and repeated rows, empty tables, and columns whose names clash: every operator has a defined result."""

import hashlib
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import common, language_model, licenses, media, mixing, nearcopies, neighbours, pieces, quality, suffixes, toxicity

LONG = " ".join(f"word{i} tail{i % 7}" for i in range(30_000))
ROWS = [
    (1, "the same text of some words that stand in two rows", "en", "a"),
    (2, "The same text of some words that stand in two rows", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n", "de", "b"),
    (6, LONG, "fr", "a"),
    (None, "a row without an id", "en", "c"),
    (7, "one", "en", ""),
    (7, "one", "en", ""),
    (8, "é" * 300 + " naïve — “text” 日本語 😀 𓀀", "es", "d"),
]
#: Names that operators use inside.
CLASHES = ["row", "key", "d", "n", "rk", "size", "target", "packed", "score", "held_out", "component_id", "uid", "offset", "bucket", "words", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1), (6, 1, 1), (8, None, None), (99, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_licenses(spark, docs):
    assert licenses.scan(docs).count() == 0
    found = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n# RELEASED under the\n# MIT license!")))
    got = by_id(licenses.scan(found))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 1, 7: 2, 8: 1}
    assert all(r["license"] == "MIT" and r["containment"] == 1.0 for v in got.values() for r in v)
    assert licenses.scan(docs.where("false")).count() == 0


def test_mixing(spark, docs):
    got = by_id(mixing.mix(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0]["size"] == 0 and got[3][0]["taken"] == 0 and got[4][0]["taken"] == 0
    assert all(r["taken"] <= 2 * r["size"] for v in got.values() for r in v)
    taken, target = {}, {}
    for v in got.values():
        for r in v:
            taken[r["target"], r["source_size"]] = taken.get((r["target"], r["source_size"]), 0) + r["taken"]
    assert all(abs(t - math.floor(k[0])) <= 1 for k, t in taken.items()), (taken, target)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix(docs.where("doc_id = 3")).first()["target"] == 0
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(1), payload=True).collect()}
    assert again == {(r["doc_id"], r["taken"]) for v in got.values() for r in v}


def test_language_model(spark, docs):
    got = by_id(language_model.score(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0]["n_tokens"] == got[4][0]["n_tokens"] == 1 and got[6][0]["n_tokens"] == 60_001 and len(got[7]) == 2
    assert got[1][0]["score"] == pytest.approx(got[2][0]["score"]) and all(math.isfinite(r["score"]) and r["score"] < 0 for v in got.values() for r in v)
    assert language_model.score(docs.where("false")).count() == 0


def test_pieces(spark, docs):
    got = by_id(pieces.encode(docs))
    assert sum(map(len, got.values())) == len(ROWS) and all(r["roundtrip"] for v in got.values() for r in v)
    assert got[3][0]["ids"] == [] and got[4][0]["n_pieces"] == 0 and got[8][0]["n_spelled"] > 0
    assert pieces.encode(docs.where("false")).count() == 0


def test_near_copies(spark, docs):
    got = by_id(nearcopies.near_copies(docs, shingle=2))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0]["component_id"] == got[2][0]["component_id"] == 1 and got[1][0]["kept"] and not got[2][0]["kept"]
    assert [got[k][0]["component_id"] for k in (3, 4, 5, 6)] == [3, 4, 5, 6] and got[3][0]["n_shingles"] == 0
    assert got[7][0]["n_shingles"] == 1 and all(r["kept"] for r in got[7]) and got[None][0]["component_id"] is None
    assert nearcopies.near_copies(docs.where("false")).count() == 0


def test_near_copies_of_few_words_alone(spark):
    df = spark.createDataFrame([(1, "one"), (2, "just four words here"), (3, "Just four words here")], "doc_id long, text string").coalesce(1)
    for size in (2, 5):
        got = by_id(nearcopies.near_copies(df.where("doc_id < 3"), shingle=size))
        assert [got[k][0]["n_shingles"] for k in (1, 2)] == [1, 3 if size == 2 else 1]
        got = by_id(nearcopies.near_copies(df, shingle=size))
        assert [got[k][0]["component_id"] for k in (1, 2, 3)] == [1, 2, 2]
        assert by_id(nearcopies.near_copies(df.where("doc_id = 1"), shingle=size))[1][0]["n_shingles"] == 1


def test_first_texts_of_a_worker_are_empty(monkeypatch):
    monkeypatch.setattr(common, "_powers", {})
    words, at = common.word_hashes(pa.array(["", None]))
    assert len(words) == 0 and at.tolist() == [0, 0, 0]


def test_pipeline_keeps_one_of_rows_that_repeat(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(90))
    rows = [(1, text(1), "a")] * 3 + [(1, text(1), "b")]  # one id and text
    rows += [(None, text(2), "a")] * 2 + [(None, text(2), "b")]  # without an id
    rows += [(5, text(3), "a"), (5, text(3) + " more", "a")]  # near copies under one id
    rows += [(6, text(4), "a"), (6, text(5), "a")]  # different texts under one id
    rows += [(None, text(6), "a"), (8, text(6) + " more", "a"), (7, text(7), "a"), (9, "", "a"), (9, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, df, "")
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["text"].split(" ")[0]) for r in left.collect()), key=str)
    assert got == sorted([(1, "w1x0"), (None, "w2x0"), (5, "w3x0"), (6, "w4x0"), (6, "w5x0"), (8, "w6x0"), (7, "w7x0"), (9, ""), (9, "")], key=str)
    through = corpus_pipeline.drop_passages(spark, left, "")
    assert sorted(r["text"].split(" ")[0] for r in through.collect()) == sorted(t for _, t in got)


def test_media(spark, docs):
    got = by_id(media.store(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[3][0]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and got[3][0]["n_bytes"] == 0 and got[3][0][1:] == got[4][0][1:]
    assert got[6][0]["payload_bytes"] % 64 == 0 and len(got[7]) == 2
    assert media.store(docs.where("false")).count() == 0


@pytest.mark.parametrize("f", [quality.classify, toxicity.score])
def test_classifiers(spark, docs, labels, f):
    got = by_id(f(docs, labels))
    assert sum(map(len, got.values())) == len(ROWS) and all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    assert got[3][0]["score"] == got[4][0]["score"] and not got[None][0]["held_out"]
    assert f(docs, labels.where("false")).count() == len(ROWS) and f(docs.where("false"), labels).count() == 0


def test_suffixes(spark, docs):
    twice = docs.where("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long"))
    got = by_id(suffixes.deduplicate(docs.union(twice)))
    assert sum(map(len, got.values())) == len(ROWS) + 1
    assert got[6][0]["n_removed"] == len(LONG) == got[60][0]["n_removed"] and got[6][0]["n_spans"] == 1
    # the run of one character repeats itself: 600 bytes have windows of 400 with the same bytes, two apart
    assert got[8][0]["n_removed"] == 600 and got[3][0]["n_bytes"] == 0 and got[7][0]["n_removed"] == 0
    assert suffixes.deduplicate(docs.where("false")).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("v", F.lit(2))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert neighbours.search(df.where("false")).count() == 0
