"""Quality classifier by positive-unlabelled learning.

Features are byte and byte-class-pair frequencies and a few shape figures of the whole text, in any language. A small network minimises the non-negative
unbiased risk: trusted positives stand for the positive part, unlabelled text for the mixture, and the class prior for the share of positives in it. Its
margin is then put on a probability scale by a logistic fit on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of each kind (positive, unlabelled, and both labels for the scale) that the model is fitted on at most: those with the smallest hashes.
SAMPLE_ROWS = 6000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

#: Classes of bytes: 0 other, 1 space, 2 end of line, 3 small, 4 capital, 5 digit, 6 in a letter beyond ASCII, 7 and on the punctuation named here.
_PUNCTUATION = (".,", "!", "?", "|", "#$%&*", "'\"", "()[]{}<>", "-_=+/\\", ":;@")
CLASS = np.zeros(256, np.int64)
CLASS[[9, 11, 12, 32]], CLASS[[10, 13]], CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4, 5, 6
for _i, _chars in enumerate(_PUNCTUATION):
    CLASS[[ord(c) for c in _chars]] = 7 + _i
WIDTH = 256 + 256 + 8


def features(texts: pa.Array) -> np.ndarray:
    """float32 rows of WIDTH, one for each text; zeros for an empty or null one."""
    data, at = common.text_buffer(texts)
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    per = np.maximum(size, 1)[:, None]
    out[:, :256] = np.sqrt(np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / per)
    kind = CLASS[data]
    inside = doc[1:] == doc[:-1]
    pair = (doc[1:] * 256 + kind[:-1] * 16 + kind[1:])[inside]
    out[:, 256:512] = np.sqrt(np.bincount(pair, minlength=n * 256).reshape(n, 256) / per)
    begin, end, of = common.words_of(data, at)
    words = np.bincount(of, minlength=n)
    w = np.maximum(words, 1)
    length = end - begin
    out[:, 512] = np.log1p(size) / 10
    out[:, 513] = np.log1p(words) / 10
    out[:, 514] = np.bincount(of, length, n) / w / 10
    out[:, 515] = np.bincount(of, length <= 3, n) / w
    out[:, 516] = np.sqrt(np.bincount(of, (kind[begin] == 4) & (kind[end - 1] >= 7), n) / w)
    h = common.span_hashes(common.prefix_sums(data), begin, end)
    order = np.lexsort((h, of))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    out[:, 517] = np.bincount(of[order], new, n) / w
    out[:, 518] = (words > 0).astype(np.float32)
    out[:, 519] = np.bincount(doc, kind == 2, n) / w
    return out


class Network:
    """One hidden layer; its margin is positive for text that looks like the positives."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = [(rng.standard_normal((width, hidden)) * 0.1).astype(np.float32), np.zeros(hidden, np.float32), (rng.standard_normal(hidden) * 0.1).astype(np.float32), np.zeros(1, np.float32)]
        self.shift, self.scale, self.slope, self.bias = np.zeros(width, np.float32), np.ones(width, np.float32), 1.0, 0.0

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.p[0] + self.p[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *((self._hidden(x[b : b + 1000]) @ self.p[2] + self.p[3]).astype(np.float64) for b in range(0, len(x), 1000))])

    def gradient(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        h = self._hidden(x)
        dh = d[:, None] * self.p[2] * (1 - h * h)
        return [((x - self.shift) / self.scale).T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.bias, -30, 30)))


def nn_pu(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, batch: int = 256, rate: float = 2e-3, decay: float = 1e-4, seed: int = 5) -> None:
    """Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss; where the second part is below 0 its gradient is reversed."""
    rng = np.random.default_rng(seed)
    n = len(positive) + len(unlabelled)
    net.shift = (positive.sum(0) + unlabelled.sum(0)) / n
    net.scale = np.sqrt(sum(((x[b : b + 1000] - net.shift) ** 2).sum(0) for x in (positive, unlabelled) for b in range(0, len(x), 1000)) / n) + np.float32(0.02)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    m, v, step = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p], 0
    for _ in range(epochs):
        pos, unl = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for b in range(0, len(unl), batch):
            xu = unlabelled[unl[b : b + batch]]
            xp = positive[np.take(pos, range(b, b + batch), mode="wrap")]
            fp, fu = net.margin(xp), net.margin(xu)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            sign = 1.0 if negative >= 0 else -1.0
            dp = (-prior * sigmoid(-fp) * (negative >= 0) - sign * prior * sigmoid(fp)) / len(xp)
            du = sign * sigmoid(fu) / len(xu)
            g = net.gradient(np.concatenate([xp, xu]), np.concatenate([dp, du]).astype(np.float32))
            step += 1
            for k, p in enumerate(net.p):
                grad = g[k] + decay * p
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def logistic_fit(f: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of the logistic fit of label y on margin f (Newton, a step is halved until it lowers the loss), with a weak pull to slope 1."""
    y = np.asarray(y, float)

    def loss(x: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (x[0] * f + x[1])).sum() + ((x[0] - 1) ** 2 + 0.1 * x[1] ** 2) / 2)

    x = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x[0] * f + x[1], -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * f).sum() + (x[0] - 1), (p - y).sum() + 0.1 * x[1]])
        step = np.linalg.solve(np.array([[(w * f * f).sum() + 1, (w * f).sum()], [(w * f).sum(), w.sum() + 0.1]]), g)
        now = loss(x)
        while loss(x - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        x = x - step
    return max(float(x[0]), 1e-3), float(x[1])


def _feature_rows(df: DataFrame, more: list[str]) -> DataFrame:
    """more columns and f, the features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in more], common.binary(list(features(part.column("text"))))], [*more, "f"])

    return df.select(*more, "text").mapInArrow(common.released(run), T.StructType([*df.select(*more).schema, T.StructField("f", T.BinaryType())]))


def may_learn(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(common.fold(FOLDS, doc_id) != HELD_OUT, F.lit(False))


def bounded(df: DataFrame, n: int) -> DataFrame:
    """n of the ids in df, those with the smallest hashes: the same ones in every run."""
    return df.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """docs: doc_id, text. labels: doc_id, quality. Learns labels of rows outside the held-out fold only; None if no positive can be learnt from.

    A label that is null is none, of several for one id the least counts. The class prior is the share of positives among the labelled rows that may be learnt from.
    """
    labels = labels.select("doc_id", "quality").where(may_learn() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    prior = labels.agg(F.avg("quality")).first()[0]
    if not prior:
        return None
    ids = docs.select("doc_id").where(may_learn()).distinct().join(labels, "doc_id", "left_anti")
    kinds = [bounded(labels.where(F.col("quality") == q).select("doc_id"), rows).withColumn("kind", F.lit(q)) for q in (0, 1)] + [bounded(ids, rows).withColumn("kind", F.lit(2))]
    asked = kinds[0].union(kinds[1]).union(kinds[2])  # 3 * rows ids at most
    # of an id that stands for several texts always the same one
    got = _feature_rows(docs.join(F.broadcast(asked), "doc_id"), ["doc_id", "kind"]).groupBy("doc_id", "kind").agg(F.min("f").alias("f")).collect()
    got.sort(key=lambda r: r["doc_id"])
    x = {k: np.array([np.frombuffer(r["f"], np.float32) for r in got if r["kind"] == k]).reshape(-1, WIDTH) for k in range(3)}
    del got
    net = Network()
    nn_pu(net, x[1], x[2] if len(x[2]) else np.concatenate([x[0], x[1]]), min(float(prior), 0.99))
    # both labels in the proportion that they have
    weight = np.concatenate([x[0], x[1][: max(1, int(len(x[0]) * prior / (1 - prior)))] if prior < 1 else x[1]])
    net.slope, net.bias = logistic_fit(net.margin(weight), np.arange(len(weight)) >= len(x[0]))
    return net


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", payload: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs; payload=True adds row, a struct of all columns of docs.

    The score is a function of the text alone, so equal texts have equal scores; null is scored as the empty text. Without labels to learn from all scores are 0.5.
    """
    common.tune(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    net = fit(plain, labels)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * payload
    source = docs.select(F.col(doc_id).alias("doc_id"), common.fold(FOLDS, F.col(doc_id)).eqNullSafe(HELD_OUT).alias("held_out"), *row, F.col(text).cast("string").alias("text"))
    keep = [c for c in source.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 19):
                p = net.probability(features(part.column("text"))) if net else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(common.released(run), T.StructType([*source.select(*keep).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
