"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split in halves, again and again, until each part has few vectors; the parts' centres are the heads of posting lists, joined by an
in-memory graph of near and far links that a beam search walks. Each vector goes to its nearest list and, near a boundary, to others as well. A query reads
the lists whose centres are within a ratio of its nearest centre's distance. Only the centres (bounded by MAX_LISTS) are sent to all tasks. Vectors of
each length have an index of their own; a length that the sample lacks has one list, which is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows that the index is fitted on at most (the smallest hashes); all rows are indexed.
SAMPLE_ROWS = 40_000
MAX_LISTS = 512
#: Sampled vectors of a list.
LIST_ROWS = 48
#: Lists a vector is put in at most, and the ratio of squared distances up to which it is.
REPLICAS, BOUNDARY = 3, 1.25
#: A chosen centre is beside another one if their squared distance is below this share of the vector's to the other.
BESIDE = 0.5
#: Lists a query reads at most, and the ratio of squared distances up to which it does.
PROBES, PRUNE = 64, 2.2
#: Rows of a list, and queries of a list, that one task takes; longer ones are split.
SPLIT_ROWS = 4096


def balanced_centres(x: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Unit centres of parts of equal size: the largest part is cut at the median along the line between two centres until parts have at most `most` rows."""
    rng, done, todo = np.random.default_rng(seed), [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        y = x[part]
        a, b = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(6):
            near = y @ (a - b) >= np.median(y @ (a - b))
            if near.all():
                break
            a, b = y[near].mean(0), y[~near].mean(0)
        order = np.argsort(y @ (a - b), kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    centres = np.array([x[p].mean(0) for p in done])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def graph(centres: np.ndarray, near: int = 24, far: int = 8, seed: int = 7) -> np.ndarray:
    """Links of each centre: its nearest ones and some random ones, by which a search leaves a local optimum."""
    n, rng = len(centres), np.random.default_rng(seed)
    if n <= near + far + 1:
        return np.tile(np.arange(n), (n, 1))
    sims = centres @ centres.T
    np.fill_diagonal(sims, -2)
    return np.hstack([np.argpartition(-sims, near, axis=1)[:, :near], rng.integers(0, n, (n, far))])


def beam_search(centres: np.ndarray, links: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row of q the centres found nearest, and their similarity, best first. All rows walk the graph in step; a walk ends when its beam holds no unvisited centre."""
    n, k = len(q), len(centres)
    width = min(width, k)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, k), bool)
    start = np.unique(np.linspace(0, k - 1, min(k, 2 * width)).astype(int))
    seen[:, start] = True
    sims = q @ centres[start].T
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    beam, best = start[order], np.take_along_axis(sims, order, 1)
    visited = np.zeros((n, beam.shape[1]), bool)
    active = np.arange(n)
    while len(active):
        a = active[:, None]
        open_ = ~visited[active]
        go = open_.argmax(1)
        live = open_[np.arange(len(active)), go]
        active, go = active[live], go[live]
        if not len(active):
            break
        a = active[:, None]
        visited[active, go] = True
        new = links[beam[active, go]]
        fresh = ~seen[a, new]
        seen[a, new] = True
        s = np.where(fresh, np.einsum("nmd,nd->nm", centres[new], q[active]), -9.0)
        ids, all_s, all_v = np.hstack([beam[active], new]), np.hstack([best[active], s]), np.hstack([visited[active], ~fresh])
        order = np.argsort(-all_s, axis=1, kind="stable")[:, : beam.shape[1]]
        beam[active], best[active], visited[active] = np.take_along_axis(ids, order, 1), np.take_along_axis(all_s, order, 1), np.take_along_axis(all_v, order, 1)
    return beam, best


def lists_for_vectors(centres: np.ndarray, links: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every copy: the nearest list, and those within the ratio unless a chosen centre is much nearer to theirs than the vector is."""
    beam, sims = beam_search(centres, links, x, 16)
    d = 2 - 2 * sims
    keep = np.zeros(beam.shape, bool)
    keep[:, 0] = True
    for j in range(1, beam.shape[1]):
        ok = np.flatnonzero((d[:, j] <= BOUNDARY * d[:, 0] + 1e-12) & (sims[:, j] > -2) & (keep.sum(1) < REPLICAS))
        for i in range(j):  # a list beside a chosen one, seen from the vector, would hold what that one holds
            apart = 2 - 2 * np.einsum("nd,nd->n", centres[beam[ok, i]], centres[beam[ok, j]])
            ok = ok[~(keep[ok, i] & (apart < BESIDE * d[ok, j]))]
        keep[ok, j] = True
    row, col = np.nonzero(keep)
    return row, beam[row, col]


def lists_for_queries(centres: np.ndarray, links: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beam, sims = beam_search(centres, links, q, PROBES)
    d = 2 - 2 * sims
    row, col = np.nonzero((d <= PRUNE * d[:, :1] + 1e-9) & (sims > -2))
    return row, beam[row, col]


def search(vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows found, by cosine, ties to the smaller id.

    Vectors null, zero or with null or non-finite components take no part, nor do rows without an id; a query's candidates are the vectors of its length, with
    which alone it has a cosine. Equal vectors are one entry of the index that holds its k + 1 smallest ids, which is all that an answer can need, so a vector that a third of
    all rows share costs as much as any other. Rows that repeat an id are one candidate. An empty table has no answers.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    base = base.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    base = base.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    base = common.materialize(base, "vectors")
    smallest = W.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = base.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v")).withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    entries = common.materialize(firsts.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = base.where(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2").distinct()
    queries = entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v")

    sample: dict[int, list] = {}
    for r in entries.select("v").orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE_ROWS).collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    index = {}
    for n, rows in sample.items():
        x = np.array(rows)
        x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        # all lengths together have MAX_LISTS lists, or one each
        most = max(1, MAX_LISTS // 2 * len(unit) // sum(map(len, sample.values())))
        centres = balanced_centres(unit, max(LIST_ROWS, -(-len(unit) // most))).astype(np.float32)
        index[n] = (centres, graph(centres))

    def routed(df: DataFrame, lists, cols: list[str]) -> DataFrame:
        schema = T.StructType([*df.select(*cols).schema, T.StructField("n", T.IntegerType()), T.StructField("list", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                whole = whole.select(cols)
                lengths = pc.list_value_length(whole.column(cols.index("v"))).to_numpy()
                for n in np.unique(lengths).tolist():
                    own = whole.take(pa.array(np.flatnonzero(lengths == n)))
                    for b in range(0, own.num_rows, 1024):
                        batch = own.slice(b, 1024)
                        row, to = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
                        if n in index:
                            x = _matrix(batch.column(cols.index("v")))
                            x = x / np.abs(x).max(1, keepdims=True)
                            row, to = lists(*index[n], (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
                        took = batch.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*took.columns, pa.array(np.full(len(row), n), pa.int32()), pa.array(to, pa.int32())], [*cols, "n", "list"])

        return df.mapInArrow(common.released(run), schema)

    placed = common.materialize(routed(entries, lists_for_vectors, ["v", "ids"]), "placed")
    probed = common.materialize(routed(queries, lists_for_queries, ["h1", "h2", "v"]), "probed")
    # a row for each list: how many parts its rows and its queries are split in; MAX_LISTS of them and one for each length of vectors
    sizes = placed.groupBy("n", "list").agg(F.count("*").alias("rows")).join(probed.groupBy("n", "list").agg(F.count("*").alias("asks")), ["n", "list"])
    split = lambda c: F.expr(f"cast(ceil({c} / {SPLIT_ROWS}) as int)")
    part = common.materialize(sizes.select("n", "list", split("rows").alias("row_parts"), split("asks").alias("query_parts")), "lists", narrow=True)
    left = placed.join(F.broadcast(part), ["n", "list"]).withColumn("row_part", F.expr("pmod(xxhash64(v), row_parts)")).withColumn("query_part", F.explode(F.expr("sequence(0, query_parts - 1)")))
    right = probed.join(F.broadcast(part), ["n", "list"]).withColumn("query_part", F.expr("pmod(h1, query_parts)").cast("int")).withColumn("row_part", F.explode(F.expr("sequence(0L, row_parts - 1L)")))
    keys = ["n", "list", "row_part", "query_part"]
    left, right = left.select(*keys, "v", "ids"), right.select(*[F.col(x).alias(f"q_{x}") for x in keys], "h1", "h2", "v")

    def score(_, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"h1": [], "h2": [], "score": [], "vec_id": []}
        if len(rows) and len(asks):
            x, q = np.array(rows["v"].tolist()), np.array(asks["v"].tolist())
            first = np.array([i[0] for i in rows["ids"]])
            # scaled so that squares neither overflow nor vanish
            x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
            xn, qn = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            ids = rows["ids"].tolist()
            for h1, h2, y, yn in zip(asks["h1"], asks["h2"], q, qn):
                s = np.clip((x @ y) / (xn * yn), -1.0, 1.0)
                cut = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -2.0
                top = np.flatnonzero(s >= cut - 1e-9)
                top = top[np.lexsort((first[top], -s[top]))][: k + 1]
                found = sorted((-(x[i] * y).sum() / (xn[i] * yn), j) for i in top for j in ids[i])[: k + 1]
                out["h1"] += [h1] * len(found)
                out["h2"] += [h2] * len(found)
                out["score"] += [-f[0] for f in found]
                out["vec_id"] += [f[1] for f in found]
        return pd.DataFrame(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{x}" for x in keys])).applyInPandas(score, "h1 long, h2 long, score double, vec_id long")
    best = W.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    mine = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.withColumnRenamed("vec_id", "query_id").join(found, ["h1", "h2"]).where("vec_id != query_id")
    return out.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
