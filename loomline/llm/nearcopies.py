"""Near-copies by SuperMinHash.

A document's set of word shingles gets a SuperMinHash signature: each element has a permutation of the components, drawn step by step, and the step number is
part of the value, so components are negatively correlated and a document stops as soon as no later step can change it. Bands of the signature make buckets;
links are confirmed on full sets; groups are joined by union-find on stars of links.

No group is ever gathered: documents with equal sets are one class; in a bucket every class is compared with one leader only; and what is then still in
different groups of one bucket is compared in blocks of signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BANDS, ROWS = 32, 5
#: Signature agreement below which a pair can't have the similarity asked for: five standard deviations of an estimate over BANDS * ROWS components.
SLACK = 0.16
BLOCK = 2048
#: Rows of 24 bytes up to which the documents asked for are sent to all tasks.
SEND_ROWS = 500_000


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each document; a document with fewer words is one shingle, one without words has none."""
    n = len(words)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(size):
            m = max(n - k, 0)  # none, where all words together are fewer than k
            h[:m] = common.mix(h[:m] * np.uint64(0x9FB21C651E98DF25) + words[k:])
        out = []
        for b, e in zip(at[:-1], at[1:]):
            if e - b >= size:
                out.append(np.unique(h[b : e - size + 1]))
            elif e > b:
                one = np.uint64(0)
                for w in words[b:e]:
                    one = common.mix(np.array([one * np.uint64(0xC2B2AE3D27D4EB4F) + w + np.uint64(e - b)]))[0]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of documents whose distinct elements stand in doc order. Step j gives element e the value j + uniform at the j-th place of e's own permutation."""
    out = np.full(n_docs * m, np.inf)
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            r = common.mix(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            k = common.mix(r + np.uint64(0xD1B54A32D192ED03))
        k = j + (((k >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                perm[np.arange(len(elements)), first], perm[:, 0] = 0, first
            rows = np.arange(len(elements))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(out, doc * m + place, j + (r >> np.uint64(11)) * 2.0**-53)
        open_ = out.reshape(n_docs, m).max(1) >= j + 1  # a later step can still lower something
        stay = open_[doc]
        if j == 0:
            first = k[stay]
        elif perm is not None and not stay.all():
            perm = perm[stay]
        if not stay.all():
            elements, doc = elements[stay], doc[stay]
    return out.reshape(n_docs, m)


def signatures(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return superminhash(np.concatenate(sets) if sets else np.zeros(0, np.uint64), doc, len(sets), m)


def _features(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rk, n, d (digest of the set, null if empty), bands, sig: one row per document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("rk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 18):
                words, at = common.word_hashes(part.column(2))
                sets = shingle_hashes(words, at, shingle)
                sig = signatures(sets).view(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(sets), 0)
                    for k in range(ROWS):
                        key = common.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, k::ROWS])
                    short = common.mix(sig).astype(np.uint16)
                n = np.array([len(s) for s in sets])
                flat = pa.array(np.ascontiguousarray(key.view(np.int64)[n > 0]).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)), flat)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands, common.binary(list(short))], ["doc_id", "rk", "n", "d", "bands", "sig"])

    return docs.mapInArrow(common.released(run), schema)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """d, s: the full sets, for the few documents that stand for a class in some pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 19):
                words, at = common.word_hashes(part.column(1))
                sets = [s.view(np.int64) for s in shingle_hashes(words, at, shingle)]
                s = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), s], ["d", "s"])

    return docs.select("d", "text").mapInArrow(common.released(run), "d binary, s array<long>")


def sets_of(asked: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """d, s of the asked classes, from one document of each. Few keys are sent to all tasks, more are joined by a shuffle."""
    rows = common.materialize(asked.join(classes.select("d", "rk"), "d"), "asked", narrow=True)
    rows = F.broadcast(rows) if rows.count() <= SEND_ROWS else rows
    # rk holds the row's id as well as its text, so copies of one text are spread, and one of them joins
    return common.materialize(_sets(docs.join(rows, "rk").select("d", "text"), shingle).dropDuplicates(["d"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class digests whose sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    common_ = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common_).where(F.col("common") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each node's edge to the smallest node of its own group."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    out = [(x, r) for x in parent if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, root: root is the smallest node that links reach, for every node that has a link.

    Parts of the edges are joined by union-find; large and small stars carry roots between parts, until every node hangs on one root that hangs on none.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        edges = common.materialize(edges.repartition(common.few(spark)).mapInArrow(common.released(_forest), "u binary, v binary"), "edges")
        roles = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).union(edges.select("v", F.lit(None).cast("binary")))
        loose = roles.groupBy("node").agg(F.count("up").alias("ups"), F.count_if(F.col("up").isNull()).alias("downs"), F.min("up").alias("lo"), F.max("up").alias("hi")).where("ups > 0 and (downs > 0 or lo != hi)")
        if loose.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least)


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """members: bucket, d, root, n, bands, sig, s. Pairs of different roots in one bucket that are linked, by their full shingles.

    Rows are compared in blocks, and a pair only in the first bucket that it shares. Signatures far apart are passed over; of the links between two groups the
    closest one is enough. Nothing is sent for a pair that is not a link.
    """
    counts = members.groupBy("bucket").count().select("bucket", F.expr(f"(count + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    rows = members.join(counts, "bucket").withColumn("own", F.expr("pmod(xxhash64(d), blocks)"))
    rows = rows.withColumn("s", F.array_sort("s")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "d", "root", "n", "bands", "sig", "s")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "d")
    least = percent / 100

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        own, n, bucket = group["own"].to_numpy(), group["n"].to_numpy().astype(float), group["bucket"][0].as_py()
        root, d = np.unique(np.array(group["root"].to_pylist(), object), return_inverse=True)[1], group["d"].to_pylist()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(len(n), -1)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        flat, at = group["s"].combine_chunks().flatten().to_numpy(), np.cumsum(np.concatenate([[0], n.astype(int)]))
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        best: dict[tuple[int, int], tuple] = {}
        for x in left:
            y = right if i != j else right[right > x]
            y = y[(root[y] != root[x]) & (np.minimum(n[y], n[x]) >= least * np.maximum(n[y], n[x]))]
            y = y[(sig[y] == sig[x]).mean(1) >= least - SLACK]
            y = y[bands[x][(bands[y] == bands[x]).argmax(1)] == bucket]
            sx = flat[at[x] : at[x + 1]]
            for k in y:
                sy = flat[at[k] : at[k + 1]]
                both = int((sy[np.minimum(np.searchsorted(sy, sx), len(sy) - 1)] == sx).sum())
                if 100 * both >= percent * (n[x] + n[k] - both):
                    groups = min(root[x], root[k]), max(root[x], root[k])
                    link = -both / (n[x] + n[k] - both), min(d[x], d[k]), max(d[x], d[k])
                    best[groups] = min(best.get(groups, link), link)
        pairs = list(best.values())
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (1, 2)], ["a", "b"]) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for b, e in zip([0, *cut], [*cut, len(keys)]):
                if b == e:
                    continue
                if last is not None and tuple(keys[b]) != last:
                    if (out := compare(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(b, e - b))
                last = tuple(keys[b])
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(common.released(run), "a binary, b binary").distinct()


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row_key (xxhash64 of id and text), first, one row per row of docs.

    Words are A-Z folded runs other than space and tab to carriage return. Null and wordless texts have no shingles and link with nothing: each is its own
    component. Rows that repeat, and texts with equal sets, are linked whatever their number. component_id is the smallest id reachable (null only if all of
    them are null), kept says that the row has that id. first says that row_key is the one that stands for the component, of all its rows that with the least id
    (null last) and then the least row_key: only rows that repeat share it. An empty table gives no rows.
    """
    common.tune(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
    rows = common.materialize(_features(source, shingle), "features")
    classes = rows.where("d is not null").groupBy("d").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("least"), F.min("doc_id").alias("min_id"), F.first("bands").alias("bands"))
    classes = common.materialize(classes.select("d", "min_id", F.col("least.rk").alias("rk"), "bands"), "classes")

    placed = classes.select("d", F.explode("bands").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("d").alias("p"), "d")).alias("leader")).where("size > 1")
    shared = common.materialize(placed.join(leaders.select("bucket", "size", F.col("leader.d").alias("leader")), "bucket").where("d != leader"), "shared")
    pairs = common.materialize(shared.select(F.least("d", "leader").alias("a"), F.greatest("d", "leader").alias("b")).distinct(), "pairs", narrow=True)
    sets = sets_of(pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct(), source, classes, shingle)
    links = common.materialize(confirmed(pairs, sets, percent), "links", narrow=True)
    roots = components(links)

    # classes that share a bucket beside its leader and are still apart
    rooted = shared.where("size > 2").select("bucket", "d").join(roots, F.col("d") == F.col("node"), "left").select("bucket", "d", F.coalesce("root", "d").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    sigs = rows.join(classes.select("d", "rk"), ["d", "rk"]).select("d", "n", "bands", "sig").dropDuplicates(["d"])
    members = rooted.join(mixed, "bucket").join(sigs, "d").join(sets, "d")
    more = common.materialize(_apart(members, percent), "more", narrow=True)
    if not more.isEmpty():
        links = links.union(confirmed(more, sets, percent))
        roots = components(links)

    named = roots.join(classes.select(F.col("d").alias("node"), "min_id", "rk"), "node")
    best = named.groupBy("root").agg(F.min("min_id").alias("component"), F.min(F.struct(F.col("min_id").isNull().alias("none"), "min_id", "rk")).alias("best"))
    named = named.select("node", "root").join(best, "root").select(F.col("node").alias("d"), "component", F.col("best.rk").alias("best"))
    ids = classes.select("d", "min_id", F.col("rk").alias("own")).join(named, "d", "left").select("d", F.coalesce("component", "min_id").alias("component_id"), F.coalesce("best", "own").alias("best"))
    out = rows.select("doc_id", "rk", "n", "d").join(ids, "d", "left")
    component = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("rk").alias("row_key"), F.coalesce(F.col("rk") == F.col("best"), F.lit(True)).alias("first"))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(common.documents(spark, sf_dir), shingle=2).drop("row_key", "first")
