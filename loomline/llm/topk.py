"""Exact top-k by inner product: ball trees, one for each shard of the vectors, searched by branch and bound.

A node's ball (centre and radius) bounds the inner product of everything in it with a query: q.c + |q| r. Nodes are opened in the order of their bounds and left out
where the bound is below the query's current k-th score. A query first visits one shard; the k-th score found there goes with it to all others. The shards' trees
and the blocks of queries are rows of their own, and each pair of them is a unit of work by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Components of a shard at most, and its rows; rows of a leaf; queries of a block; shards that one task searches one after another for a block.
SHARD_NUMBERS, SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, SHARDS = 1 << 20, 2048, 64, 4096, 4
#: A float64 holds integers up to here, an int64 up to there.
EXACT, LONG = 1 << 53, (1 << 63) - 1


class Tree:
    """A ball tree: rows in the tree's order, nodes level by level (the children of node k are 2k + 1 and 2k + 2), each with the range of its rows and its ball."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray | None = None, radius: np.ndarray | None = None) -> None:
        """Built from rows in any order, or with the balls of one that was built."""
        self.ids, self.x = ids, x
        self.depth = max(0, -(-len(ids) // LEAF_ROWS) - 1).bit_length()
        self.begin, self.end = np.zeros((2 << self.depth) - 1, np.int64), np.full((2 << self.depth) - 1, len(ids))
        self.centre, self.radius = centre, radius
        if x.dtype == object:
            return  # such numbers have no bounds in float64, and all rows are looked at
        if centre is None:
            order = np.argsort(ids, kind="stable")
            points = x.astype(np.float64)
        for k in range((1 << self.depth) - 1):
            b, e = self.begin[k], self.end[k]
            if centre is None:
                rows = order[b:e]
                own = points[rows]
                order[b:e] = rows[np.argsort(own @ _axis(own), kind="stable")]
            middle = (b + e) // 2
            self.begin[2 * k + 1], self.end[2 * k + 1], self.begin[2 * k + 2] = b, middle, middle
            self.end[2 * k + 2] = e
        if centre is None:
            self.ids, self.x, points = ids[order], x[order], points[order]
            balls = [points[b:e] for b, e in zip(self.begin, self.end)]
            self.centre = np.array([own.mean(0) for own in balls])
            self.radius = np.array([np.sqrt(((own - c) ** 2).sum(1).max()) for own, c in zip(balls, self.centre)])

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """No row of a node scores more than this with a query; what rounding may take is added. A score isn't below the least long."""
        norm = np.sqrt((q * q).sum(1))[:, None]
        reach = np.sqrt((self.centre[nodes] ** 2).sum(1)) + self.radius[nodes]
        return np.maximum(q @ self.centre[nodes].T + norm * (self.radius[nodes] + 1e-9 * reach) + 1e-6, -float(1 << 63))


def _axis(points: np.ndarray) -> np.ndarray:
    """From the point farthest from the mean to the point farthest from that."""
    one = points[((points - points.mean(0)) ** 2).sum(1).argmax()]
    return points[((points - one) ** 2).sum(1).argmax()] - one


class Best:
    """The k best rows of each query so far, by score and then the smaller id, and the score that a row needs (the least long while there are fewer)."""

    def __init__(self, asks: np.ndarray, least: np.ndarray, k: int, repeats: bool) -> None:
        self.asks, self.least, self.k, self.repeats = asks, least.copy(), k, repeats
        self.score, self.ids, self.have = np.zeros((len(asks), k), np.int64), np.zeros((len(asks), k), np.int64), np.zeros((len(asks), k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The scores of some queries with some ids."""
        able = (scores >= self.least[rows][:, None]) & (ids[None, :] != self.asks[rows][:, None])
        some = np.flatnonzero(able.any(1))
        if not len(some):
            return
        rows = rows[some]
        score, have = np.hstack([self.score[rows], scores[some]]), np.hstack([self.have[rows], able[some]])
        ids = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(some), len(ids)))])
        order = np.lexsort((ids, ~score, ~have), axis=1)  # the complement falls as the score rises, and knows no overflow
        if self.repeats:  # of an id's rows only the best counts
            ids, score, have = (np.take_along_axis(a, order, 1) for a in (ids, score, have))
            by_id = np.lexsort((np.broadcast_to(np.arange(ids.shape[1]), ids.shape), ids, ~have), axis=1)
            sorted_ids = np.take_along_axis(ids, by_id, 1)
            again = np.zeros(ids.shape, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            back = np.zeros(ids.shape, bool)
            np.put_along_axis(back, by_id, again, 1)
            have &= ~back
            order = np.argsort(~have, axis=1, kind="stable")
        order = order[:, : self.k]
        kept = [np.take_along_axis(a, order, 1) for a in (score, ids, have)]
        self.score[rows], self.ids[rows], self.have[rows] = kept
        full = rows[kept[2].all(1)]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])

    def answers(self) -> pa.StructArray:
        row, col = np.nonzero(self.have)
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()) for a in (self.asks[row], self.ids[row, col], self.score[row, col])], ["query_id", "vec_id", "score"])


def number_kind(x: np.ndarray, q: np.ndarray) -> type:
    """The cheapest kind of numbers in which the inner products of such integers are exact."""
    if object in (x.dtype, q.dtype):
        return object
    bound = max(1, x.shape[1])
    for a in (x, q):
        bound *= max(1, int(a.max()), -int(a.min())) if a.size else 1
    return np.float64 if bound < EXACT else np.int64 if bound < LONG else object


def search_shard(tree: Tree, q: np.ndarray, best: Best) -> None:
    """Adds a shard's rows to the best of the queries q, but for those that a ball shows to be below what a query has."""
    kind = number_kind(tree.x, q)
    x, exact = tree.x.astype(kind), q.astype(kind)
    every = np.arange(len(q))

    def scores(rows: np.ndarray, b: int, e: int) -> np.ndarray:
        out = exact[rows] @ x[b:e].T
        return (np.clip(out, -LONG - 1, LONG) if kind is object else out).astype(np.int64)

    if tree.x.dtype == object or q.dtype == object or not tree.x.shape[1]:
        best.add(every, tree.ids, scores(every, 0, len(tree.ids)))
        return
    points = q.astype(np.float64)
    leaves = np.arange(1 << tree.depth)
    first = len(leaves) - 1

    def visit(rows: np.ndarray, to: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        begins = np.flatnonzero(np.diff(to, prepend=-1))
        for own, leaf in zip(np.split(rows, begins[1:]), to[begins]):
            b, e = tree.begin[first + leaf], tree.end[first + leaf]
            best.add(own, tree.ids[b:e], scores(own, b, e))

    # level by level; a bound equal to the k-th score may hide a smaller id
    bound = np.zeros((len(q), 1))
    for level in range(tree.depth + 1):
        nodes = np.arange((1 << level) - 1, (2 << level) - 1)
        above = np.repeat(bound, 2, axis=1) if level else np.full((len(q), 1), np.inf)
        some = np.flatnonzero((above > -np.inf).any(0))
        bound = np.full(above.shape, -np.inf)
        bound[:, some] = np.minimum(above[:, some], tree.bounds(points, nodes[some]))
        bound[bound < best.least[:, None]] = -np.inf
    # then leaves by their bounds, until the next one is below the k-th score
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in leaves:
        leaf = order[:, turn]
        go = np.flatnonzero((bound[every, leaf] > -np.inf) & (bound[every, leaf] >= best.least))
        if not len(go):
            break
        visit(go, leaf[go])


def _quantised(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of equally long vectors: int32 or int64, or Python's integers where those are too small."""
    flat = column.flatten()
    x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(column), -1 if len(flat) else 0)
    most = np.abs(x).max() if x.size else 0
    if most >= 2.0**62:  # a double that large is an integer, whose product may be no double
        return np.array([int(y) * SCALE if abs(y) >= 2.0**53 else int(np.floor(y * SCALE)) for y in flat.to_pylist()], object).reshape(x.shape)
    return x.astype(np.int32 if most < 2**31 else np.int64)


def _bytes(x: np.ndarray) -> bytes:
    return b"w" + " ".join(map(str, x.ravel())).encode() if x.dtype == object else x.dtype.char.encode() + np.ascontiguousarray(x).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    if data[:1] == b"w":
        return np.array([int(s) for s in data[1:].split()], object).reshape(-1, n)
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).reshape(-1, n) if n else np.zeros((0, 0), np.int32)


_SHARD = "n int, part int, ids binary, v binary, centre binary, radius binary"
_BLOCK = "n int, part int, ids binary, v binary"
_FOUND = "n int, part int, least binary, answers array<struct<query_id: long, vec_id: long, score: long>>"


def _block(rows: pa.Table) -> pa.Table:
    """A group of vectors as one row."""
    return _row(rows, np.ascontiguousarray(rows.column("vec_id").to_numpy(), np.int64), _quantised(rows.column("v").combine_chunks()))


def _shard(rows: pa.Table) -> pa.Table:
    """A group of vectors as one row, in the order of its ball tree."""
    tree = Tree(np.ascontiguousarray(rows.column("vec_id").to_numpy(), np.int64), _quantised(rows.column("v").combine_chunks()))
    centre, radius = (b"" if a is None else a.tobytes() for a in (tree.centre, tree.radius))
    return _row(rows, tree.ids, tree.x).append_column("centre", pa.array([centre], pa.binary())).append_column("radius", pa.array([radius], pa.binary()))


def _row(rows: pa.Table, ids: np.ndarray, x: np.ndarray) -> pa.Table:
    return pa.table({"n": rows.column("n")[:1], "part": rows.column("part")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([_bytes(x)], pa.binary())})


def _searched(k: int, repeats: bool):
    """Searches rows of a shard and a block of queries each; what a block has found goes on with it from shard to shard."""

    def found(key: tuple, best: Best) -> pa.RecordBatch:
        answers = best.answers()
        lists = pa.ListArray.from_arrays(pa.array([0, len(answers)], pa.int32()), answers)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([best.least.tobytes()], pa.binary()), lists], ["n", "part", "least", "answers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, q = None, None, None
        for batch in batches:
            for place in range(batch.num_rows):
                u = batch.slice(place, 1).to_pylist()[0]
                n = u["n"]
                if (n, u["block"]) != now:
                    if now:
                        yield found(now, best)
                    now, asks, q = (n, u["block"]), np.frombuffer(u["q_ids"], np.int64), _numbers(u["q_v"], n)
                    q = q if n else np.zeros((len(asks), 0), np.int32)
                    best = Best(asks, np.frombuffer(u["least"], np.int64) if u["least"] else np.full(len(asks), -LONG - 1), k, repeats)
                ids, x = np.frombuffer(u["ids"], np.int64), _numbers(u["v"], n)
                x = x if n else np.zeros((len(ids), 0), np.int32)
                plain = x.dtype == object
                tree = Tree(ids, x) if plain else Tree(ids, x, np.frombuffer(u["centre"], np.float64).reshape(-1, n) if n else np.zeros((1, 0)), np.frombuffer(u["radius"], np.float64))
                search_shard(tree, q, best)
        if now:
            yield found(now, best)

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other ids of the highest integer inner product, ties to the smaller id.

    Components become floor(1024 x). Vectors null or with null or non-finite components take no part, nor do rows without an id. Vectors of other lengths have no
    inner product with a query and are no candidates of it; empty vectors score 0 with each other. Rows that repeat an id are one candidate and one query, with the
    best score that any of them has. Scores are exact; one beyond a long counts as the nearest long. Shards and blocks have bounded numbers of rows, whatever
    vectors repeat. An empty table has no answers.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    tasks = common.parts(spark)
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    base = base.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    base = common.materialize(base.distinct().withColumn("n", F.size("v")), "vectors")
    repeats = bool(base.groupBy("vec_id").count().where("count > 1").limit(1).count())
    # a row for each length of vectors, of which a table has no more than about the square root of twice its components
    sizes = base.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("asks"))
    most = f"greatest({LEAF_ROWS}, least({SHARD_ROWS}, {SHARD_NUMBERS} div greatest(n, 1)))"
    sizes = F.broadcast(common.materialize(sizes.select("n", F.expr(f"cast(ceil(rows / {most}) as int) as shards"), F.expr(f"cast(ceil(asks / {BLOCK_ROWS}) as int) as blocks")), "sizes", narrow=True))
    base = base.join(sizes, "n").where("blocks > 0")

    def packed(rows: DataFrame, parts: str, pack, schema: str) -> DataFrame:
        part = F.expr(f"cast(pmod(xxhash64(vec_id, v), {parts}) as int)")
        return common.materialize(rows.select("n", part.alias("part"), "vec_id", "v").groupBy("n", "part").applyInArrow(pack, schema), parts).join(sizes, "n")

    shards = packed(base, "shards", _shard, _SHARD).withColumnRenamed("part", "shard")
    blocks = packed(base.where(F.col("vec_id") % every == 0), "blocks", _block, _BLOCK)
    blocks = blocks.select("n", F.col("part").alias("block"), "shards", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    home = F.expr("pmod(block, shards)")

    # each block in one shard, for a k-th score that goes with it to the others
    begun = blocks.withColumn("shard", home).withColumn("least", F.lit(None).cast("binary")).join(shards.drop("shards", "blocks"), ["n", "shard"])
    begun = begun.repartition(tasks, "n", "block").mapInArrow(common.released(_searched(k, repeats)), _FOUND)
    begun = common.materialize(begun, "begun")
    known = blocks.join(begun.select("n", F.col("part").alias("block"), "least"), ["n", "block"])
    known = known.withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).where(F.col("shard") != home).drop("shards")
    rest = shards.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("shards", "blocks")
    units = known.join(rest, ["n", "shard", "block"]).repartition(tasks, "n", "block", F.expr(f"shard div {SHARDS}")).sortWithinPartitions("n", "block", "shard")
    found = begun.unionByName(units.mapInArrow(common.released(_searched(k, repeats)), _FOUND)).select(F.inline("answers"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id, max(cast(list_inner_product(q.v, c.v) as bigint)) as score
  from v q join v c on q.vec_id % 100 = 0 and len(q.v) = len(c.v) and q.vec_id <> c.vec_id group by all
),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 10"""
