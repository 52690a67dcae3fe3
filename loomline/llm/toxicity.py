"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words come in by a hashed word embedding and the mean of hashed embeddings of their character trigrams. All overlapping windows of a text are scored; the
text's margin is that of its worst window. In training a positive text's loss goes to its windows by their share in a soft maximum, and all windows of a clean
text are clean. One component of the word embedding begins at the evidence that the word's occurrence in training texts gives, and so does a weight by which a word
adds to its windows' margins beside the recurrence, so few texts are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gru, quality

WINDOW, STRIDE = 24, 16
WORDS, GRAMS, DIM, HIDDEN, ATTENTION = 1 << 13, 1 << 12, 12, 8, 8
#: Clean and toxic texts that the model is fitted on at most, and labelled texts for its scale: those with the smallest hashes.
FIT_ROWS, SCALE_ROWS = (2700, 900), 2000
THRESHOLD = 0.3
#: A word's evidence times this is the weight with which it begins to add to margins by itself.
DIRECT = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of some texts: runs of letters and digits, A-Z folded. uses has each word's number among the distinct ones, at where each text's words begin."""

    def __init__(self, texts: pa.Array) -> None:
        data, at = common.text_buffer(texts)
        data = np.where(_LETTER[data], common.fold_case(data), np.uint8(32))
        begin, end, of = common.words_of(data, at)
        h = common.span_hashes(common.prefix_sums(data), begin, end)
        distinct, first, self.uses = np.unique(h, return_index=True, return_inverse=True)
        self.at = np.searchsorted(of, np.arange(len(at)))
        self.bucket = (distinct % np.uint64(WORDS)).astype(np.int64)
        # trigrams of " word ": each byte of the word with its neighbours
        b, n = begin[first], (end - begin)[first]
        self.gram_at = np.cumsum(n) - n
        p = np.repeat(b - self.gram_at, n) + np.arange(n.sum())
        left, right = np.where(p == np.repeat(b, n), 32, data[np.maximum(p - 1, 0)]), np.where(p == np.repeat(b + n - 1, n), 32, data[np.minimum(p + 1, len(data) - 1)]) if len(data) else (p, p)
        code = (left.astype(np.uint64) << np.uint64(16)) | (data[p].astype(np.uint64) << np.uint64(8)) | right.astype(np.uint64) if len(data) else p.astype(np.uint64)
        self.grams = (common.mix(code) % np.uint64(GRAMS)).astype(np.int64)
        self.count = n

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows, WINDOW) word numbers, -1 beyond a text's end, and the text of each window. Every text has one at least."""
        n = np.diff(self.at)
        k = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        of = np.repeat(np.arange(len(n)), k)
        begin = (np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)
        inside = place < n[of][:, None]
        return np.where(inside, self.uses[np.minimum(place + self.at[of][:, None], max(len(self.uses) - 1, 0))] if len(self.uses) else -1, -1), of


class Network:
    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.ew, self.ec = (rng.standard_normal((k, DIM)).astype(np.float32) * np.float32(0.1) for k in (WORDS, GRAMS))
        self.wx, self.bx = gru.uniform(rng, 2 * DIM, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32)
        self.wf, self.wb = gru.uniform(rng, HIDDEN, 3 * HIDDEN), gru.uniform(rng, HIDDEN, 3 * HIDDEN)
        self.wa, self.va = gru.uniform(rng, 2 * HIDDEN, ATTENTION), gru.uniform(rng, ATTENTION, 1)[:, 0]
        self.wo, self.bo = gru.uniform(rng, 2 * HIDDEN, 1)[:, 0], np.array([-2.0], np.float32)
        self.direct = np.zeros(WORDS, np.float32)
        self.slope, self.bias = 1.0, 0.0

    def params(self) -> list[np.ndarray]:
        return [self.ew, self.ec, self.wx, self.bx, self.wf, self.wb, self.wa, self.va, self.wo, self.bo, self.direct]

    def embed(self, words: Words) -> np.ndarray:
        mean = np.add.reduceat(self.ec[words.grams], words.gram_at, axis=0) / words.count[:, None].astype(np.float32) if len(words.count) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.ew[words.bucket], mean], 1)

    def project(self, words: Words, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct word the inputs of both directions and what it adds by itself, and a last row for -1. x is what embed() gave."""
        x = self.embed(words) if x is None else x
        return np.concatenate([x @ self.wx + self.bx, np.zeros((1, 6 * HIDDEN), np.float32)]), np.append(self.direct[words.bucket], np.float32(0))

    def forward(self, inputs: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Margins of windows; inputs are what project() gave."""
        projected, alone = inputs
        n = len(ids)
        states = np.zeros((2, WINDOW, n, HIDDEN), np.float32)
        cache: list[list] = [[], []]
        mask = (ids >= 0).astype(np.float32)
        for k, (w, order) in enumerate(((self.wf, range(WINDOW)), (self.wb, range(WINDOW - 1, -1, -1)))):
            h = np.zeros((n, HIDDEN), np.float32)
            x = projected[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            for t in order:
                new = gru.step(x[ids[:, t]], h, w, cache[k] if keep is not None else None)
                h = h + mask[:, t, None] * (new - h)
                states[k, t] = h
        both = np.concatenate([states[0], states[1]], 2)
        u = np.tanh(both @ self.wa)
        e = u @ self.va + (mask.T - 1) * np.float32(30)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = (alpha[:, :, None] * both).sum(0)
        if keep is not None:
            keep |= {"cache": cache, "both": both, "u": u, "alpha": alpha, "pooled": pooled, "mask": mask}
        return pooled @ self.wo + self.bo + alone[ids].sum(1)

    def gradients(self, words: Words, x: np.ndarray, ids: np.ndarray, keep: dict, d: np.ndarray) -> list[np.ndarray]:
        """Of all parameters, for the margins' gradient d; x is what embed() gave."""
        both, u, alpha, mask = keep["both"], keep["u"], keep["alpha"], keep["mask"]
        dwo, dpooled = keep["pooled"].T @ d, d[:, None] * self.wo
        dalpha = (dpooled * both).sum(2)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        du = de[:, :, None] * self.va * (1 - u * u)
        dboth = alpha[:, :, None] * dpooled + du @ self.wa.T
        dwa = np.tensordot(both, du, ((0, 1), (0, 1)))
        dproj = np.zeros((len(x) + 1, 6 * HIDDEN), np.float32)
        dw = [np.zeros_like(self.wf), np.zeros_like(self.wb)]
        for k, (w, order) in enumerate(((self.wf, range(WINDOW - 1, -1, -1)), (self.wb, range(WINDOW)))):
            dh = np.zeros((len(ids), HIDDEN), np.float32)
            for t in order:
                dh += dboth[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t, None]
                i = t if k == 0 else WINDOW - 1 - t
                dx, before, da = gru.back(dh * m, keep["cache"][k][i], w)
                dw[k] += keep["cache"][k][i][0].T @ da
                np.add.at(dproj[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], ids[:, t], dx)
                dh = before + dh * (1 - m)
        dproj = dproj[:-1]
        dx = dproj @ self.wx.T
        dew, dec = np.zeros_like(self.ew), np.zeros_like(self.ec)
        np.add.at(dew, words.bucket, dx[:, :DIM])
        np.add.at(dec, words.grams, np.repeat(dx[:, DIM:] / words.count[:, None].astype(np.float32), words.count, axis=0))
        alone, direct = np.zeros(len(x) + 1, np.float32), np.zeros_like(self.direct)
        np.add.at(alone, ids, d[:, None])
        np.add.at(direct, words.bucket, alone[:-1])
        return [dew, dec, x.T @ dproj, dproj.sum(0), dw[0], dw[1], dwa, np.tensordot(de, u, ((0, 1), (0, 1))), dwo, d.sum(keepdims=True), direct]

    def margins(self, texts: pa.Array, most: int = 4096) -> np.ndarray:
        """The largest window margin of each text."""
        words = Words(texts)
        inputs = self.project(words)
        ids, of = words.windows()
        out = np.full(len(texts), -np.inf)
        for b in range(0, len(ids), most):
            np.maximum.at(out, of[b : b + most], self.forward(inputs, ids[b : b + most]).astype(float))
        return out

    def all_margins(self, texts: list[str]) -> np.ndarray:
        """margins() of some texts at a time."""
        return np.concatenate([self.margins(pa.array(texts[b : b + 200], pa.string())) for b in range(0, len(texts), 200)])

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.bias, -30, 30)))


def evidence(texts: list[str], labels: np.ndarray, least: float = 2.5, most: float = 5.0) -> np.ndarray:
    """For each word bucket how much more often toxic texts have it than clean ones: the signed root of twice the log likelihood ratio, beyond `least`, up to `most`."""
    has = np.zeros((2, WORDS))
    for k in range(0, len(texts), 100):
        words = Words(pa.array(texts[k : k + 100]))
        for y, b, e in zip(labels[k : k + 100].tolist(), words.at[:-1], words.at[1:]):
            has[y, np.unique(words.bucket[words.uses[b:e]])] += 1
    n = np.bincount(labels, minlength=2)[:, None]
    seen = np.stack([has, n - has])
    expected = seen.sum(1, keepdims=True) * n / n.sum()
    ratio = 2 * (seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))).sum((0, 1))
    return np.sign(has[1] / n[1] - has[0] / n[0]) * np.clip(np.sqrt(np.maximum(ratio, 0)) - least, 0, most)


def ranking(margins: np.ndarray, labels: np.ndarray) -> float:
    """How often a toxic text's margin is above a clean one's; ties count half."""
    order = np.sort(margins)
    rank = (np.searchsorted(order, margins, "left") + np.searchsorted(order, margins, "right") + 1) / 2
    toxic, n = labels == 1, int((labels == 1).sum())
    return float((rank[toxic].sum() - n * (n + 1) / 2) / max(n * (len(labels) - n), 1))


def train(texts: list[str], labels: np.ndarray, held: list[str], held_labels: np.ndarray, epochs: int = 8, per_batch: int = 40, rate: float = 6e-3, clean_windows: int = 10, seed: int = 11) -> Network:
    """The network after the epoch that ranks the held texts best, so that few texts aren't learnt by heart."""
    net, rng = Network(seed), np.random.default_rng(seed)
    told = evidence(texts, labels).astype(np.float32)
    net.ew[:, 0] += 2 * told
    net.direct += DIRECT * told
    adam = gru.Adam(net.params(), rate)
    best, kept_at = -1.0, [p.copy() for p in net.params()]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), per_batch):
            own = order[b : b + per_batch]
            words = Words(pa.array([texts[i] for i in own]))
            ids, of = words.windows()
            y = labels[own][of].astype(np.float32)
            # of a clean text a few random windows are enough at a time
            keep_ = (y > 0) | (rng.random(len(of)) < clean_windows / np.bincount(of, minlength=len(own))[of])
            ids, of, y = ids[keep_], of[keep_], y[keep_]
            x = net.embed(words)
            kept: dict = {}
            f = net.forward(net.project(words, x), ids, kept)
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            top = np.full(len(own), -np.inf, np.float32)
            np.maximum.at(top, of, f)
            share = np.exp(2 * (f - top[of]))
            share /= np.bincount(of, share, len(own))[of]
            n_clean = np.bincount(of, minlength=len(own))[of]
            d = np.where(y > 0, -(1 - p) * share, p / np.minimum(n_clean, 4)).astype(np.float32) / len(own)
            adam.update(net.gradients(words, x, ids, kept, d))
            # embeddings of words seen once should not tell texts apart
            net.ew *= np.float32(0.997)
            net.ec *= np.float32(0.999)
        if (now := ranking(net.all_margins(held), held_labels)) > best:
            best, kept_at = now, [p.copy() for p in net.params()]
    for p, at_best in zip(net.params(), kept_at):
        p[...] = at_best
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """docs: doc_id, text. labels: doc_id, toxic. Learns labels of rows outside the held-out fold only; None if both labels can't be learnt from.

    A label that is null is none, of several for one id the largest counts. Fit and scale use different rows; those of the scale also say when to stop.
    """
    labels = labels.select("doc_id", "toxic").where(quality.may_learn() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4))
    sample = [quality.bounded(labels.where((F.col("toxic") == y) & (part > 0)), FIT_ROWS[y]) for y in (0, 1)] + [quality.bounded(labels.where(part == 0), SCALE_ROWS)]
    asked = sample[0].union(sample[1]).union(sample[2]).withColumn("scale", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0)
    # of an id that stands for several texts always the same one; sum(FIT_ROWS) + SCALE_ROWS at most
    one = F.min_by(F.struct("text", "toxic", "scale"), F.struct(F.xxhash64("text"), "text"))
    rows = docs.join(F.broadcast(asked), "doc_id").groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    own = [r for r in rows if not r["scale"]]
    y = np.array([r["toxic"] for r in own])
    if not len(y) or y.min() == y.max():
        return None
    held = [r for r in rows if r["scale"]] or own
    held_texts, held_labels = [r["text"] or "" for r in held], np.array([r["toxic"] for r in held])
    net = train([r["text"] or "" for r in own], y, held_texts, held_labels)
    net.slope, net.bias = quality.logistic_fit(net.all_margins(held_texts), held_labels)
    return net


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs.

    The score is a function of the text alone; null is scored as the empty text, which has one window without words. Other columns play no part, rows that repeat
    stay. Without both labels to learn from all scores are 0.
    """
    common.tune(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    net = fit(plain, labels)
    source = plain.select("doc_id", common.fold(quality.FOLDS).eqNullSafe(quality.HELD_OUT).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                p = net.probability(part.column(2)) if net else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(common.released(run), T.StructType([*source.select("doc_id", "held_out").schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
