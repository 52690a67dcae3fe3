import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import alignment as al
from loomline.operators import chapters
from loomline.plans import catalog


def pair(a, b, ah=None, bh=None):
    return al.Pair(np.array(a, np.int64), np.array(b, np.int64), np.array(ah or [False] * len(a), bool), np.array(bh or [False] * len(b), bool))


def scalar(p, lo=None, hi=None):
    """The whole lattice cell by cell: cost of the best path, and its beads."""
    best = {(0, 0): (0.0, None)}
    for i in range(p.n + 1):
        for j in range(p.m + 1):
            for k, (di, dj) in enumerate(al.STEPS):
                if (i - di, j - dj) in best and i >= di and j >= dj and (di or dj):
                    v = best[i - di, j - dj][0] + float(p.step_cost(k, np.array([i - di]), np.array([j - dj]))[0])
                    if (i, j) not in best or v < best[i, j][0]:
                        best[i, j] = (v, k)
    out, i, j = [], p.n, p.m
    while i or j:
        k = best[i, j][1]
        out.append(al.STEPS[k])
        i, j = i - al.STEPS[k][0], j - al.STEPS[k][1]
    return best[p.n, p.m][0], out[::-1]


def some(rng, n):
    return [rng.choice([40, 40, 80, 120, 300]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_sweep_is_the_cell_by_cell_optimum(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 14), rng.randint(1, 14)
    p = pair(some(rng, n), some(rng, m), [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.2 for _ in range(m)])
    status, _, _, beads, cost = al.align_pair(p)
    want, path = scalar(p)
    assert status == "ok" and beads == path and cost == pytest.approx(want)


def test_beads_cover_both_sides_and_reverse_alike():
    rng = random.Random(3)
    a = some(rng, 30)
    b = [x + rng.randint(-9, 9) for x in a]
    beads = al.align_pair(pair(a, b))[3]
    assert sum(x for x, _ in beads) == 30 and sum(y for _, y in beads) == 30
    assert al.align_pair(pair(a[::-1], b[::-1]))[3] == beads[::-1]


def test_degenerate_sides():
    assert al.align_pair(pair([], []))[3] == []
    assert al.align_pair(pair([5], []))[3] == [(1, 0)]
    assert al.margins(pair([5], []), [(1, 0)]) == [math.inf]


def test_ceiling_refuses_and_caps():
    assert al.align_pair(pair([50] * 10, [50] * 10), ceiling=10)[0] == "too_big"
    status, band, *_ = al.align_pair(pair([50] * 300, [50] * 3 + [2000] * 290), ceiling=300 * 200)
    assert status in ("ok", "capped") and 300 * (2 * band + 1) <= 300 * 200


def test_a_narrow_corridor_widens():
    a = [200] * 200
    b = [10] * 150 + [200] * 200
    assert al.align_pair(pair(a, b))[2] >= 1


def test_margins_match_the_lattice_and_shuffles_are_doubted(spark):
    rng = random.Random(5)
    a = [rng.choice([30, 90, 200, 450]) for _ in range(12)]
    p = pair(a, a)
    beads = al.align_pair(p)[3]
    sure = al.margins(p, beads)
    assert len(sure) == len(beads) and min(x for x in sure[:-1]) > 0
    shuffled = a[:4] + [a[6], a[4], a[5]] + a[7:]
    q = pair(a, shuffled)
    assert min(al.margins(q, al.align_pair(q)[3])[:-1]) < min(sure[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_margins_are_those_of_the_whole_lattice(seed):
    rng = random.Random(seed)
    p = pair(some(rng, rng.randint(2, 9)), some(rng, rng.randint(2, 9)))
    ways = {(0, 0): [(0.0, ())]}
    for i in range(p.n + 1):
        for j in range(p.m + 1):
            for k, (di, dj) in enumerate(al.STEPS):
                if (i - di, j - dj) in ways and (di or dj):
                    cost = float(p.step_cost(k, np.array([i - di]), np.array([j - dj]))[0])
                    ways.setdefault((i, j), []).extend((c + cost, (*path, (i, j))) for c, path in sorted(ways[i - di, j - dj])[:4000])
    beads = al.align_pair(p)[3]
    whole, at, want = ways[p.n, p.m], (0, 0), []
    for x, y in beads:
        at = at[0] + x, at[1] + y
        others = [c for c, path in whole if any(i == at[0] and j != at[1] for i, j in ((0, 0), *path))]
        want.append(min(others) - min(c for c, _ in whole) if others else math.inf)
    assert al.margins(p, beads) == pytest.approx(want)


def test_a_cell_of_the_corridor_costs_about_a_byte():
    rng = np.random.default_rng(1)
    p = pair(rng.integers(20, 400, 1200).tolist(), rng.integers(20, 400, 1200).tolist())
    lo, hi = al.corridor(p.n, p.m, 96)
    tracemalloc.start()
    al.banded(p, 96)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * (hi - lo + 1).sum() + 1_500_000


def test_pairs_are_dealt_to_several_tasks(spark):
    df = spark.createDataFrame([(f"p{k}", i, "p", "x" * (20 + i)) for k in range(12) for i in range(4)], "pair_id string, seq int, tag string, frag string")
    tasks = al.align(df, df).select(F.spark_partition_id().alias("t"), "pair_id").distinct().collect()
    assert len({r["t"] for r in tasks}) > 3 and len(tasks) == 12


def test_dataframe_align_doubt_and_chapters(spark):
    blocks = [("x", 0, "h1", "One"), ("x", 1, "p", "a" * 50), ("x", 2, "h2", "Two"), ("x", 3, "p", "b" * 70), ("x", 4, "h2", "Three"), ("x", 5, "p", "c" * 60)]
    df = spark.createDataFrame(blocks, "pair_id string, seq int, tag string, frag string")
    beads = al.doubtful(al.align(df, df))
    rows = chapters.of_beads(beads, df, df).orderBy("bead").collect()
    assert [r["a_n"] for r in rows] == [1] * 6 and not any(r["doubtful"] for r in rows)
    assert [r["level"] for r in rows] == [1] * 6  # one h1 a side is two in all
    stats = chapters.statistics(chapters.of_beads(beads, df, df), "pair_id", "chapter").collect()
    assert [(s["chapter"], s["n11"], s["a"], s["b"]) for s in stats] == [(1, 6, 6, 6)]


def test_leading_text_is_a_chapter_of_its_own(spark):
    rows = [("x", 0, "p", "front"), ("x", 1, "h2", "A"), ("x", 2, "p", "t"), ("x", 3, "h2", "B")]
    df = spark.createDataFrame(rows, "book string, seq int, tag string, frag string")
    got = chapters.titles(chapters.of_blocks(df, "book"), "book").orderBy("chapter").collect()
    assert [(r["chapter"], r["title"], r["blocks"]) for r in got] == [(1, None, 1), (2, "A", 2), (3, "B", 1)]


def test_one_sided_pair_is_one_bead(spark):
    a = spark.createDataFrame([("x", 0, "p", "abc"), ("x", 1, "p", "d")], "pair_id string, seq int, tag string, frag string")
    got = al.align(a, a.where("false")).collect()
    assert [(r["a_n"], r["b_n"], r["margin"]) for r in got] == [(2, 0, math.inf)]


def test_many_small_pairs_share_an_arrow_batch(spark):
    rng = random.Random(5)
    sides = [{f"p{i}": some(rng, rng.randrange(1, 7)) for i in range(i0, 40 + i0)} for i0 in (0, 3)]  # p0 to p2 and p40 to p42 have one side
    rows = [[(k, s, "h2" if s == 2 else "p", "x" * n) for k, v in side.items() for s, n in enumerate(v)] for side in sides]
    a, b = (spark.createDataFrame(random.Random(6).sample(x, len(x)), "pair_id string, seq int, tag string, frag string") for x in rows)
    plan = al.align(a, b)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan  # a call of pandas for each pair costs ten times what the pair does
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # pairs lie across batches
    try:
        got = al.align(a, b).orderBy("pair_id", "bead").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for k in sorted(set(sides[0]) | set(sides[1])):
        x, y = (side.get(k, []) for side in sides)
        p = pair(x, y, [s == 2 for s in range(len(x))], [s == 2 for s in range(len(y))])
        status, band, attempts, beads, cost = al.align_pair(p)
        at = np.cumsum([(0, 0), *beads], 0).tolist()
        want += [(k, status, band, attempts, n, *(v for u, w in zip(at[n], bead) for v in (u, w)), cost, m) for n, (bead, m) in enumerate(zip(beads, al.margins(p, beads)))]
    assert [tuple(r) for r in got] == want


def test_step_cost_11_has_every_pair(spark):
    small = "/root/testdata/sf0.01"
    lengths = [{k: [len(re.sub("<[^>]+>", "", x)) for x in g] for k, g in side.toPandas().sort_values("seq").groupby("pair_id").frag} for side in catalog.sides(spark, small)]
    want, far = {}, 0
    for k, a in lengths[0].items():
        b = lengths[1][k]
        mean = b[0] * ((sum(a) or 1) / (sum(b) or 1)) or 1.0
        z = abs(a[0] - mean) / math.sqrt(mean * 6.8)
        far += z >= 6
        want[k] = -100 * math.log(0.89) - 100 * math.log(max(2 * (1 - 0.5 * (1 + math.erf(z / math.sqrt(2)))), 1e-30))
    got = {r["pair_id"]: r["cost"] for r in catalog.QUERIES["step_cost_11"](spark, small).collect()}
    assert far > 0 and got == pytest.approx(want, abs=2e-3)


def long_pair(spark, path):
    """conversations.parquet with one conversation of 32,400 turns against 3: a corridor of 8 % would hold more bytes than CORRIDOR_BYTES."""
    turns = spark.range(32403).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") < 32400, "user").otherwise("assistant").alias("role"),
        F.repeat(F.lit("x"), (20 + F.col("id") * 37 % 200).cast("int")).alias("text"),
    )
    turns.write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_doubtful_beads_has_the_beads_of_a_long_pair(spark, tmp_path):
    rows = catalog.QUERIES["doubtful_beads"](spark, long_pair(spark, tmp_path)).agg(F.sum("a_n"), F.sum("b_n"), F.count("margin"), F.count("*")).first()
    assert rows[:2] == (32400, 3) and rows[2] == rows[3]


def test_merged_chapters_has_the_chapter_of_a_long_pair(spark, tmp_path):
    row = catalog.QUERIES["merged_chapters"](spark, long_pair(spark, tmp_path)).first()
    assert row and (row["a"], row["b"], row["body"].count('<p class="a"'), row["body"].count('<p class="b')) == (32400, 3, 32400, 3)


def test_merged_books_has_the_book_of_a_long_pair(spark, tmp_path):
    row = catalog.QUERIES["merged_books"](spark, long_pair(spark, tmp_path)).first()
    assert row and (row["book"], row["a"], row["b"]) == ("7.epub", 32400, 3)


def test_path_points_ends_in_the_corner_of_a_long_pair(spark, tmp_path):
    points = catalog.QUERIES["path_points"](spark, long_pair(spark, tmp_path))
    assert points.where("bead is null or i is null or j is null").isEmpty()
    assert points.agg(F.max_by(F.struct("i", "j"), "bead")).first()[0] == (32400, 3)


def test_a_corridor_without_a_path_is_not_a_bead():
    status, _, attempts, beads, cost = al.align_pair(pair([50], [50] * 1000), ceiling=200)
    assert (status, attempts, beads) == ("too_big", 1, []) and math.isnan(cost)


def test_margins_compare_paths_far_from_the_best():
    rng = random.Random(852)
    a, b = [rng.choice([1, 900]) for _ in range(48)], [rng.choice([1, 900]) for _ in range(95)]

    def cells(p):
        cost = np.full((p.n + 1, p.m + 1), np.inf)
        cost[0, 0] = 0.0
        for i in range(p.n + 1):
            for j in range(p.m + 1):
                for k, (di, dj) in enumerate(al.STEPS):
                    if i >= di and j >= dj:
                        cost[i, j] = min(cost[i, j], cost[i - di, j - dj] + float(p.step_cost(k, np.array([i - di]), np.array([j - dj]))[0]))
        return cost

    p = pair(a, b)
    through = cells(p) + cells(pair(a[::-1], b[::-1]))[::-1, ::-1]
    beads = al.align_pair(p)[3]
    want = [np.delete(through[i], j).min() - through[p.n, p.m] for i, j in np.cumsum(beads, 0).tolist()]
    assert al.margins(p, beads) == pytest.approx(want)


def test_a_path_clear_of_the_corridors_walls_is_not_taken_for_the_best():
    rng = random.Random(118)
    verse = [rng.randint(20, 900) for _ in range(rng.randint(100, 300))]
    other = [rng.randint(20, 900) for _ in range(rng.randint(70, 200))]
    p = pair(verse + other, other + verse)
    _, touched, cost = al.banded(p, 64)
    assert not touched and al.align_pair(p)[4] < cost - 400


@pytest.mark.parametrize("held", [900, 20000])
def test_parts_of_a_lattice_give_the_same_path_and_margins(monkeypatch, held):
    rng = random.Random(9)
    x = some(rng, 70), some(rng, 55), [rng.random() < 0.1 for _ in range(70)], [rng.random() < 0.1 for _ in range(55)]
    want = al.align_pair(pair(*x))
    sure = al.margins(pair(*x), want[3])
    monkeypatch.setattr(al, "HELD_BYTES", held)
    monkeypatch.setattr(al, "TABLE_CELLS", 1)
    assert al.align_pair(pair(*x)) == want and al.margins(pair(*x), want[3]) == sure
