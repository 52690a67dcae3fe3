"""Filter interactions, source divergence and exact top-k: SQL on the small tables, plain computations on small fixtures, and edge cases."""

import collections
import itertools
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import common, divergence, interactions, neighbours, queries, topk

DIR = "/root/testdata/sf0.001"
CLASHES = ["row", "part", "h1", "h2", "n", "mask", "good", "toxic", "first", "rows", "spread", "term", "count", "docs", "item", "value", "rank", "shard", "block", "v", "key", "words"]
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans(common.UPPER, common.LOWER)


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in df.columns])


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.values.tolist()))


@pytest.mark.parametrize("name", ["op11_interactions", "op12_divergence", "op13_top_k"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert canonical(queries.QUERIES[name](spark, DIR).toPandas()) == canonical(con.sql(queries.ORACLE_SQL[name]).df())


LONG = " ".join(f"Word{i} tail{i % 3}" for i in range(20_000))
DOCS = [
    (1, "the same text # of words", "en", "a"), (2, "the same text # of words", "en", "a"), (2, "the same text # of words", "en", "a"), (3, "the same text # of words", None, "b"), (None, "the same text # of words", "en", "b"),
    (4, None, "en", None), (5, "", None, "b"), (6, " \t\n", "de", "b"), (7, LONG, "fr", "a"), (None, "without AN ID", "en", "c"), (8, "ONE", "en", ""), (8, "two other", "en", ""),
    (9, "é" * 300 + " naïve — “text” 日本語 😀 𓀀", "es", "d"), (10, " ".join(["x"] * 250), "en", "a"), (11, " ".join(f"w{i}" for i in range(250)), "en", "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 1, 1), (10, None, 1), (99, 1, 1), (None, 1, 1), (8, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))


def plain_interactions(rows, labels):
    """Every order applied to every row, one filter after another."""
    first, marks = {}, collections.defaultdict(lambda: [False, False])
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            marks[i] = [marks[i][0] or q == 1, marks[i][1] or x == 1]
    fails = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", f, *(marks[i] if i is not None else (False, False))))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    removed = collections.Counter()
    for part in {f[0] for f in fails}:
        for order in orders:
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order, 1):
                goes = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                all_ = [f for f in fails if f[0] == part and f[1][name]]
                removed[part, name] += len(goes)
                out[part, order, step] = (len(left), len(goes), len(all_) - len(goes), sum(sum(f[1].values()) == 1 for f in all_), sum(f[2] for f in goes), sum(f[3] for f in goes))
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions_by_applying_every_order(spark, docs, labels, monkeypatch):
    want = plain_interactions(DOCS, LABELS)
    for common_rows in (interactions.COMMON, 3):  # with and without texts that are joined by broadcast
        monkeypatch.setattr(interactions, "COMMON", common_rows)
        got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in interactions.audit(docs, labels).collect()}
        assert got == want
    assert interactions.audit(docs.where("false"), labels).count() == 0
    assert interactions.audit(docs.where("doc_id = 4"), labels.where("false")).count() == 600


def test_interactions_shuffle_no_words(spark):
    base = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    plan = interactions.text_facts(base)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    # texts come together, and after that nothing moves
    assert len(exchanges) == 2 and all("hashpartitioning(h1" in x and "word" not in x for x in exchanges)


def plain_divergence(rows, least, top):
    terms = [(lang or "", source or "", [t.translate(FOLD) for t in TERM.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in terms}:
        df = collections.Counter(x for g, _, ts in terms if g == lang for x in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: collections.Counter(x for g, h, ts in terms if (g, h) == (lang, s) for x in ts if x in set(kept)) for s in {t[1] for t in terms if t[0] == lang}}
        total = sum(counts.values(), collections.Counter())

        def p(c, t, kept=kept):
            return 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = sorted(((-sum(abs(p(c, t) - p(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            above = sorted((p(total, t) - p(c, t), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(total, t))[:top]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(above, 1)]
    return sorted(out)


def test_divergence_by_plain_counting(spark, docs, monkeypatch):
    draw = np.random.default_rng(2)
    words = ["alpha", "Beta", "beta", "é", "日本", "x" * 40, "y" * 31, "y" * 32, "a-b", "it's", "z9z"]
    rows = DOCS + [(i, " ".join(draw.choice(words, draw.integers(0, 9))), draw.choice(["en", "fr"]), draw.choice(["a", "b", "c", "d"])) for i in range(20, 120)]
    df = clashing(spark.createDataFrame([(a if a is None else int(a), b, c if c is None else str(c), d if d is None else str(d)) for a, b, c, d in rows], "doc_id long, text string, lang string, source string")).repartition(5)
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 7)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for least, top, block in ((30, 50, 200_000), (5, 2, 3), (1, 50, 10), (10**6, 50, 10)):
        monkeypatch.setattr(divergence, "BLOCK_ENTRIES", block)
        got = sorted(tuple(r[c] for c in columns) for r in divergence.audit(df, least, top).collect())
        assert got == plain_divergence(rows, least, top)
    assert divergence.audit(docs.where("false")).count() == 0


def test_hashes_are_those_of_the_library_and_equal_ones_are_verified(monkeypatch):
    draw = np.random.default_rng(0)
    data = draw.integers(0, 256, 4000, np.uint8)
    begin = np.sort(draw.integers(0, 3900, 300))
    end = begin + draw.integers(1, 90, 300)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    assert divergence.xxh64(padded, begin, end).tolist() == [xxhash.xxh64_intdigest(data[b:e].tobytes()) for b, e in zip(begin, end)]
    slices = [padded[b:e].tobytes() for b, e in zip(begin, end)] * 2
    begin, end = np.tile(begin, 2), np.tile(end, 2)
    monkeypatch.setattr(divergence, "xxh64", lambda d, b, e: (e - b).astype(np.uint64) % np.uint64(3))  # nearly all clash
    codes, firsts = divergence.grouped(padded, begin, end)
    assert [slices[firsts[c]] for c in codes] == slices and len(firsts) == len(set(slices)) and codes.max() + 1 == len(firsts)


def test_distances_of_rows():
    draw = np.random.default_rng(4)
    for _ in range(50):
        n, m = draw.integers(1, 6), draw.integers(1, 9)
        z, dense, stored = draw.integers(0, 50, n), draw.integers(0, 50, (n, m)), draw.random((n, m)) < 0.4
        dense = np.where(stored, dense, z[:, None])
        at = np.concatenate([[0], np.cumsum(stored.sum(1))])
        got = divergence.row_distances(z, at, np.nonzero(stored)[1], dense[stored], m)
        assert got.tolist() == np.abs(dense[:, None, :] - dense[None, :, :]).sum(2).tolist()


def plain_top(rows, k, every):
    best = {}
    vectors = [(i, [int(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for i, e in vectors:
        for j, f in vectors:
            if i % every == 0 and i != j and len(e) == len(f):
                score = max(min(sum(a * b for a, b in zip(e, f)), 2**63 - 1), -(2**63))
                best[i, j] = max(best.get((i, j), score), score)
    out = []
    for i in {i for i, _ in best}:
        out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted((-s, j) for (a, j), s in best.items() if a == i)[:k], 1)]
    return sorted(out)


def test_top_k_by_all_products(spark, monkeypatch):
    draw = np.random.default_rng(1)
    near = draw.normal(size=(6, 5))
    rows = [(i, [float(x) for x in near[i % 6] + 0.1 * draw.normal(size=5)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 5) for i in range(300)]  # one vector that a third of all rows share
    rows += [(7, [float(i), 1.0, 1.0, 1.0, 1.0]) for i in range(30)]  # an id that repeats
    rows += [(600 + i, [1e200 * i, 1.0, 1.0]) for i in range(1, 102)] + [(100, [1e15] * 5), (0, [3e15, -1e15, 0.0, 0.0, 1.0])]
    rows += [(1000, []), (1001, []), (1002, None), (1100, [None]), (None, [1.0] * 5), (1, [float("nan")] * 5), (2, [float("inf")] * 5), (-100, [-1.0] * 5), (900, [0.0] * 7)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    for shard, block, leaf in ((60, 3, 8), (2048, 4096, 64)):
        for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", block), ("LEAF_ROWS", leaf)):
            monkeypatch.setattr(topk, name, value)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
        assert got == plain_top(rows, 10, 100)
    assert topk.top_k(df.where("false")).count() == 0


def test_a_ball_tree_leaves_rows_out_and_loses_none():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16)) * 1000
    x = np.floor(centres[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 16)) * 20).astype(np.int32)
    tree = topk.Tree(np.arange(4000), x)
    assert sorted(tree.ids.tolist()) == list(range(4000)) and tree.depth >= 5
    for b, e, c, r in zip(tree.begin, tree.end, tree.centre, tree.radius):
        assert np.sqrt(((tree.x[b:e] - c) ** 2).sum(1)).max() <= r + 1e-6
    q = x[::100]
    best = topk.Best(np.arange(4000)[::100], np.full(len(q), -topk.LONG - 1), 10, False)
    looked = []
    add = best.add
    best.add = lambda rows, ids, scores: (looked.append(scores.size), add(rows, ids, scores))
    topk.search_shard(tree, q, best)
    scores = q.astype(np.int64) @ x.T.astype(np.int64)
    scores[np.arange(len(q)), np.arange(4000)[::100]] = np.iinfo(np.int64).min
    for k in range(len(q)):
        want = np.lexsort((np.arange(4000), ~scores[k]))[:10]  # the complement, as the least long has no negative
        assert best.ids[k].tolist() == want.tolist() and best.score[k].tolist() == scores[k][want].tolist()
    assert sum(looked) < 0.35 * len(q) * 4000


def test_op10_answers_every_length(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(120)] + [(200 + 50 * i, draw.normal(size=2).tolist()) for i in range(4)] + [(501, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(9))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    want = []
    for i, v in rows:
        if i % 50 == 0:
            near = sorted((-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in rows if j != i and len(w) == len(v))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(near, 1)]
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_op10_scores_are_exact_and_in_order(spark):
    got = queries.QUERIES["op10_neighbours"](spark, DIR).toPandas()
    e = pd.read_parquet(f"{DIR}/embeddings.parquet").set_index("vec_id").embedding
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in e.items()}
    assert np.allclose(got.score, [unit[a] @ unit[b] for a, b in zip(got.query_id, got.vec_id)], atol=1e-12)
    for _, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
    assert set(got.query_id) == {i for i in e.index if i % 50 == 0}


def test_batches_of_no_terms():
    empty = pa.RecordBatch.from_pydict({"text": ["", "1 2 3"], "lang": ["a", "a"], "source": ["", "b"]}, pa.schema([(c, pa.string()) for c in ("text", "lang", "source")]))
    assert divergence.term_counts(empty).to_pylist() == [{"lang": "a", "source": "", "term": "", "count": 0, "docs": 1}, {"lang": "a", "source": "b", "term": "", "count": 0, "docs": 1}]
