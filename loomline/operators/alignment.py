"""Alignment of two ordered block sequences by length, and how sure each pairing is.

The lattice of a pair is swept by anti-diagonals: every step raises i + j by one to four, so the cells of a diagonal don't depend on each other and numpy
relaxes them at once, with four earlier diagonals at hand. All cells are swept; a part of them is held at a time. Callers may bound the cells by a corridor, which is
doubled until the path stays clear of its walls, or is as wide as their ceiling of bytes allows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from .dealing import dealt, in_batches

# Fixed values of the cost model: probability of each kind of bead (blocks of a, blocks of b), in the order in which ties prefer it; variance per character;
# what two headings together win, or one heading against text loses; cost of a skipped character and of a skipped heading.
PRIORS = {(2, 2): 0.011, (2, 1): 0.089, (1, 2): 0.089, (1, 1): 0.89, (1, 0): 0.0099, (0, 1): 0.0099}
VARIANCE, HEADING, SKIP, SKIP_HEADING = 6.8, 900.0, 0.55, 200.0
LEAST_PROBABILITY = 1e-30
CORRIDOR_BYTES, HOSTED_CORRIDOR_BYTES = 160 << 20, 56 << 20
OPENING_BAND, OPENING_SHARE = 64, 0.08
#: What is held of a lattice at a time, and what an array takes beside its cells; cells from which on costs are looked up, and the most entries of a step's table.
HELD_BYTES, ARRAY_HEAD = 32 << 20, 200
TABLE_CELLS, TABLE_ENTRIES = 1 << 14, 1 << 22
DOUBT_RATIO, DOUBT_FLOOR = 0.25, 8.0

STEPS = list(PRIORS)
COSTS = [-100.0 * math.log(p) for p in PRIORS.values()]
DI, DJ, COST = *np.array(STEPS).T, np.array(COSTS)
#: So many of the steps pair blocks; they come first.
PAIRED = sum(di > 0 and dj > 0 for di, dj in STEPS)
_erf = np.frompyfunc(math.erf, 1, 1)  # the tail's digits are those of the platform's erf
#: From here on erf is 1 in 64 bits, and what a length costs then.
ERF_IS_ONE, LARGEST_COST = 6.0, float(-100.0 * np.log(LEAST_PROBABILITY))
BEADS = "pair_id string, status string, band int, attempts int, bead int, a_from int, a_n int, b_from int, b_n int, cost double, margin double"


def length_cost(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """-100 ln of the chance of a length at least as far from the mean. Uses 1 - cdf as it stands: its cliff past 8 deviations is part of the model."""
    mean = np.where(mean <= 0, 1.0, mean)
    z = np.abs((x - mean) / np.sqrt(mean * VARIANCE)) / math.sqrt(2.0)
    cost = np.full(z.shape, LARGEST_COST)
    near = np.flatnonzero(z < ERF_IS_ONE)  # beyond, nothing is left of the tail
    tail = 2.0 * (1.0 - 0.5 * (1.0 + _erf(z[near]).astype(float)))
    cost[near] = -100.0 * np.log(np.maximum(tail, LEAST_PROBABILITY))
    return cost


@dataclass
class Pair:
    """Lengths and heading flags of both sides; ratio is that of all their characters."""

    a_len: np.ndarray
    b_len: np.ndarray
    a_head: np.ndarray
    b_head: np.ndarray

    def __post_init__(self) -> None:
        self.n, self.m = len(self.a_len), len(self.b_len)
        self.ratio = (int(self.a_len.sum()) or 1) / (int(self.b_len.sum()) or 1)
        self.a_sum, self.b_sum = (np.concatenate([[0], np.cumsum(x)]) for x in (self.a_len, self.b_len))
        self.a_heads, self.b_heads = (np.concatenate([[0], np.cumsum(x)]) for x in (self.a_head, self.b_head))
        self._tables: list[Callable[[int, int, int], np.ndarray]] | None = None

    def step_costs(self, k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the steps k, which ascend, from the cells (i, j): all in few calls, whatever their kinds."""
        di, dj = DI[k], DJ[k]
        x, y = self.a_sum[i + di] - self.a_sum[i], (self.b_sum[j + dj] - self.b_sum[j]) * self.ratio
        ah, bh = self.a_heads[i + di] > self.a_heads[i], self.b_heads[j + dj] > self.b_heads[j]
        p = int(np.searchsorted(k, PAIRED))  # paired steps come first
        cost = COST[k]
        cost[:p] += length_cost(x[:p].astype(float), y[:p])
        cost[p:] += SKIP * np.where(di[p:] > 0, x[p:], y[p:])
        if ah.any() or bh.any():
            cost[:p] = np.where(ah[:p] & bh[:p], cost[:p] - HEADING, np.where(ah[:p] != bh[:p], cost[:p] + HEADING, cost[:p]))
            cost[p:] = np.where(ah[p:] | bh[p:], cost[p:] + SKIP_HEADING, cost[p:])
        return cost

    def step_cost(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of step k from the cells (i, j)."""
        return self.step_costs(np.full(len(i), k), i, j)

    def tables(self, cells: int) -> list[Callable[[int, int, int], np.ndarray]]:
        """By step: what it costs from (i, j), (i + 1, j - 1) and so on, so many. Costs go by lengths and heading flags, of which long sides repeat most, so they are looked
        up where what occurs is much less than the cells. None for few cells."""
        if cells < TABLE_CELLS:
            return []
        if self._tables is None:
            self._tables = [self._table(k, min(cells // 4, TABLE_ENTRIES)) for k in range(len(STEPS))]
        return self._tables

    def _table(self, k: int, entries: int) -> Callable[[int, int, int], np.ndarray]:
        di, dj = STEPS[k]
        kinds = []
        for sums, heads, d in ((self.a_sum, self.a_heads, di), (self.b_sum, self.b_heads, dj)):
            i = np.arange(len(sums) - d)
            kinds.append(np.unique(2 * (sums[i + d] - sums[i]) + (heads[i + d] > heads[i]), return_index=True, return_inverse=True)[1:])
        (at_a, a), (at_b, b) = kinds
        if len(at_a) * len(at_b) > entries:
            return lambda i, j, n: self.step_cost(k, np.arange(i, i + n), np.arange(j, j - n, -1))
        table = self.step_cost(k, np.repeat(at_a, len(at_b)), np.tile(at_b, len(at_a)))
        a, b, end = a * len(at_b), b[::-1].copy(), len(b) - 1
        return lambda i, j, n: table[a[i : i + n] + b[end - j : end - j + n]]


def diagonals(pair: Pair, lo: np.ndarray, hi: np.ndarray, begin: int = 0, before: Sequence[tuple[int, np.ndarray]] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Least cost from (0, 0) to each cell with lo[i] <= j <= hi[i], diagonal by diagonal from begin on: first i, costs, steps taken. before: first i and costs of the (up to four) diagonals before."""
    n, m = pair.n, pair.m
    rows, all_ = np.arange(n + 1), np.arange(n + m + 1)
    near, far = rows + lo, rows + hi  # the diagonals on which a row begins and ends
    firsts, lasts = np.searchsorted(far, all_).tolist(), (np.searchsorted(near, all_, "right") - 1).tolist()
    tables = pair.tables(int((hi - lo + 1).sum()))
    earlier = deque(before, 4)
    for d in range(begin, n + m + 1):
        first = firsts[d]
        width = lasts[d] - first + 1
        best = np.full(width, np.inf)
        step = np.full(width, 255, np.uint8)
        if d == 0 and width:
            best[0] = 0.0
        came = []  # by step: the cells that it leads to, and what they cost before it
        for k, (di, dj) in enumerate(STEPS):
            if d < di + dj:
                continue
            f0, prior = earlier[-di - dj]
            # the cells of this diagonal whose step begins in the earlier one
            b, e = max(0, f0 + di - first), min(width, f0 + di + len(prior) - first, d - dj - first + 1)
            if b >= e:
                continue
            value = prior[b + first - di - f0 : e + first - di - f0]
            if tables:
                i = first + b - di
                v = value + tables[k](i, d - di - dj - i, e - b)
                less = v < best[b:e]
                np.copyto(best[b:e], v, where=less)
                step[b:e][less] = k
                continue
            own = np.arange(b, e)
            if not (fine := np.isfinite(value)).all():
                own, value = own[fine], value[fine]
            if len(own):
                came.append((k, own, value))
        if came:
            kinds, at = np.repeat([k for k, _, _ in came], [len(own) for _, own, _ in came]), np.concatenate([own for _, own, _ in came])
            from_i = at + first - DI[kinds]
            v = np.concatenate([value for _, _, value in came]) + pair.step_costs(kinds, from_i, d - first - at - DJ[kinds])
            at_ = 0
            for k, own, _ in came:
                now = v[at_ : at_ + len(own)]
                at_ += len(own)
                less = now < best[own]
                best[own[less]], step[own[less]] = now[less], k
        earlier.append((first, best))
        yield first, best, step


def backwards(pair: Pair, lo: np.ndarray, hi: np.ndarray, what: int, begin: int = 0, end: int | None = None, before: Sequence[tuple[int, np.ndarray]] = ()) -> Iterator[tuple[int, int, np.ndarray]]:
    """d, first i and costs (what 1) or steps taken (what 2) of the diagonals, from the last to the first.

    HELD_BYTES of them are held at a time. Of longer lattices the costs at the cuts between parts are, and each part is swept again from there: memory grows with a side only.
    """
    end = pair.n + pair.m + 1 if end is None else end
    # a diagonal has a cell a row, and no more than there are columns in one; an array has a head, too
    row = min(pair.n + 1, int((hi - lo).max()) + 1)
    size = (end - begin) * (row * (8 if what == 1 else 1) + ARRAY_HEAD)
    if size <= HELD_BYTES or end - begin <= 8:
        held = [(x[0], x[what]) for x in islice(diagonals(pair, lo, hi, begin, before), end - begin)]
        for d in range(end - 1, begin - 1, -1):
            yield d, *held.pop()
        return
    # no more parts than needed, nor than cuts can be held
    parts = min(size // HELD_BYTES + 1, max(2, HELD_BYTES // (4 * (8 * row + ARRAY_HEAD))), (end - begin) // 4)
    cuts = [begin + (end - begin) * p // parts for p in range(parts + 1)]
    recent, at = deque(before, 4), {c: tuple(before) for c in cuts[:-1]}
    for d, (first, costs, _) in enumerate(islice(diagonals(pair, lo, hi, begin, before), cuts[-2] - begin), begin + 1):
        recent.append((first, costs))
        if d in at:
            at[d] = tuple(recent)
    for b, e in zip(cuts[-2::-1], cuts[:0:-1]):
        yield from backwards(pair, lo, hi, what, b, e, at.pop(b))


def corridor(n: int, m: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi of each row, around the line from corner to corner; halves round to even."""
    mid = np.array([round(i * ((m / n) if n else 0.0)) for i in range(n + 1)])
    lo, hi = np.maximum(0, mid - band), np.minimum(m, mid + band)
    lo[n], hi[n] = min(lo[n], m), m
    return lo, hi


def best_path(pair: Pair, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int] | None, bool, float]:
    """Steps of the best path through the cells with lo[i] <= j <= hi[i], whether it ran along a wall, and its cost."""
    n, m = pair.n, pair.m
    i, j, out, touched = n, m, [], False
    for d, first, step in backwards(pair, lo, hi, 2):
        if d != i + j or not d:
            continue
        if (j <= lo[i] or j >= hi[i]) and not (j == 0 and lo[i] == 0) and not (j == m and hi[i] == m):
            touched = True
        k = int(step[i - first]) if 0 <= i - first < len(step) else 255
        if k == 255:
            return None, True, math.inf
        out.append(k)
        i, j = i - STEPS[k][0], j - STEPS[k][1]
    k = np.array(out[::-1])
    i, j = np.cumsum(DI[k]) - DI[k], np.cumsum(DJ[k]) - DJ[k]
    costs = np.empty(len(k))
    order = np.argsort(k, kind="stable")
    costs[order] = pair.step_costs(k[order], i[order], j[order])
    return k.tolist(), touched, float(np.cumsum(costs)[-1])  # added in the order of the path, as the lattice does


def banded(pair: Pair, band: int) -> tuple[list[int] | None, bool, float]:
    """Steps of the best path in the corridor, whether it ran along a wall, and its cost."""
    return best_path(pair, *corridor(pair.n, pair.m, band))


def whole(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """lo and hi of each row of the whole lattice."""
    return np.zeros(pair.n + 1, np.int64), np.full(pair.n + 1, pair.m)


def align_pair(pair: Pair, ceiling: int | None = None) -> tuple[str, int, int, list[tuple[int, int]], float]:
    """Status, band, attempts, beads as (blocks of a, blocks of b), cost. A side without blocks gives one bead of all there is.

    The path is the best of the whole lattice, of which a part is held at a time; the status is ok. Callers who want a pair refused rather than waited for give a ceiling of
    bytes: then a corridor widens under it, and the status is ok (clear of its walls), capped (pressed against them) or too_big (no bead).
    """
    n, m = pair.n, pair.m
    if not n or not m:
        return "ok", 0, 0, [(n, m)] if n or m else [], 0.0
    if ceiling is None:
        path, _, cost = best_path(pair, *whole(pair))
        return "ok", m, 1, [STEPS[k] for k in path], cost
    band, attempts = max(OPENING_BAND, int(OPENING_SHARE * max(n, m))), 0
    if n * (2 * band + 1) > ceiling:
        return "too_big", band, 0, [], math.nan
    while True:
        attempts += 1
        path, touched, cost = banded(pair, band)
        wider = min(band * 2, m)
        if path is not None and not touched or band >= m:
            return "ok", band, attempts, [STEPS[k] for k in path], cost
        if n * (2 * wider + 1) > ceiling:
            # a corridor without a path has no beads to show
            return ("too_big", band, attempts, [], math.nan) if path is None else ("capped", band, attempts, [STEPS[k] for k in path], cost)
        band = wider


def margins(pair: Pair, beads: list[tuple[int, int]]) -> list[float]:
    """Per bead: how much more the best path through another column of its end row would cost; infinite where there is none. All columns are compared."""
    n, m = pair.n, pair.m
    if not beads or not n or not m:
        return [math.inf] * len(beads)
    # the way back is the way forward of the reversed pair, whose steps start where these end
    back = Pair(pair.a_len[::-1], pair.b_len[::-1], pair.a_head[::-1], pair.b_head[::-1])
    # of each row the best cost through one of its cells, that cell's column, and the best through another
    best, second, place, total = np.full(n + 1, np.inf), np.full(n + 1, np.inf), np.full(n + 1, -1), math.inf
    for (d, first, forward), (_, backward, _) in zip(backwards(pair, *whole(pair), 1), diagonals(back, *whole(back))):
        if d == n + m:
            total = float(forward[0])
        through = forward + backward[::-1]
        rows = slice(first, first + len(through))
        old = best[rows]
        second[rows] = np.minimum(second[rows], np.maximum(old, through))
        place[rows] = np.where(through < old, d - np.arange(rows.start, rows.stop), place[rows])
        best[rows] = np.minimum(old, through)
    i, j = np.cumsum(np.array(beads), 0).T
    other = np.where(place[i] == j, second[i], best[i])
    return np.where(np.isfinite(other) & math.isfinite(total), other - total, math.inf).tolist()


def align(a: DataFrame, b: DataFrame, ceiling: int | None = None, confidence: bool = True) -> DataFrame:
    """a, b: pair_id, seq, tag, frag. One row per bead. With a ceiling, a pair that exceeds it has one row without a bead and status too_big; without one every pair is aligned.

    Only lengths and heading flags go to Python. A pair is one task's work; its time grows with the product of its sides, its memory doesn't. Pairs are dealt by key to a
    fixed number of tasks, whatever their bytes. Their rows pass through in order, many pairs to an Arrow batch, as most are small.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(BEADS))

    def narrow(df: DataFrame, side: int) -> DataFrame:
        n, head = F.coalesce(F.length(tx.strip_tags("frag")), F.lit(0)), F.coalesce(tx.is_heading("tag"), F.lit(False))
        return df.select(F.col("pair_id").cast("string").alias("pair_id"), F.lit(side).alias("side"), F.col("seq").cast("int").alias("seq"), n.alias("len"), head.alias("head"))

    def beads_of(key: str | None, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        side, n, head = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(side, 1))
        pair = Pair(n[:cut], n[cut:], head[:cut], head[cut:])
        status, band, attempts, beads, cost = align_pair(pair, ceiling)
        sure = margins(pair, beads) if confidence else [None] * len(beads)
        cost = None if math.isnan(cost) else cost
        i = j = 0
        for k, ((x, y), s) in enumerate(zip(beads, sure)):
            yield key, status, band, attempts, k, i, x, j, y, cost, s
            i, j = i + x, j + y
        if not beads:
            yield key, status, band, attempts, None, None, None, None, None, cost, None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            side, n, head = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3, 4))
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
                if begin == end:
                    continue
                if held and keys[begin] != now:
                    yield from beads_of(now, held)
                    held = []
                now = keys[begin]
                held.append((side[begin:end], n[begin:end].astype(np.int64), head[begin:end]))
        if held:
            yield from beads_of(now, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), schema, lambda row: 100)

    return dealt(narrow(a, 0).unionByName(narrow(b, 1)), "pair_id").sortWithinPartitions("pair_id", "side", "seq").mapInArrow(run, BEADS)


def doubtful(beads: DataFrame, ratio: float = DOUBT_RATIO, floor: float = DOUBT_FLOOR) -> DataFrame:
    """beads with doubtful: the margin is under max(ratio * upper median of the pair's finite margins, floor). A margin without alternatives is never doubtful."""
    finite = F.collect_list(F.when((F.col("margin") < float("inf")) & ~F.isnan("margin"), F.col("margin")))
    limits = beads.groupBy("pair_id").agg(tx.upper_median(finite).alias("middle")).select("pair_id", F.greatest(F.col("middle") * ratio, F.lit(floor)).alias("_limit"))
    return beads.join(limits, "pair_id").withColumn("doubtful", F.coalesce((F.col("margin") < F.col("_limit")) & ~F.isnan("margin"), F.lit(False))).drop("_limit")


def step_costs(rows: DataFrame, x: str = "x", y: str = "y", ratio: str = "ratio") -> DataFrame:
    """rows with cost: a 1:1 bead's cost without headings, for lengths x and y and the pair's ratio."""
    schema = rows.withColumn("cost", F.lit(0.0)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cost=COSTS[STEPS.index((1, 1))] + length_cost(f[x].to_numpy(float), f[y].to_numpy(float) * f[ratio].to_numpy(float)))

    return rows.mapInPandas(run, schema)
