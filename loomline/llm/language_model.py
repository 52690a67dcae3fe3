"""Language-model scoring with a gated recurrent unit and a class-factored output softmax.

Counts of all training words are kept in parts by word fingerprint. The most frequent words (the head) are the network's vocabulary; every other word is one
input and one output symbol, and its share of that symbol's probability is its smoothed count among them. The network is trained by truncated back-propagation
on all training texts, in shards whose parameters are averaged; a text's score carries the state from its first word to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gru

FOLDS, HELD_OUT = 5, 1
#: Words of the network; with the end and the symbol for all others it has two more.
HEAD = 8190
CLASSES, DIM, HIDDEN = 96, 24, 24
#: A shard has about so many tokens.
SHARD_TOKENS = 1_000_000
LANES, STEPS, RATE = 256, 16, 1e-2
#: All texts are gone through once; if they have fewer tokens than this together, more often, up to MAX_EPOCHS times.
EPOCH_TOKENS, MAX_EPOCHS = 1_000_000, 4
#: Rows of a window up to which a class is computed together with others, and the least share of the largest one's rows that each of them has.
TOGETHER, FILLED = 64, 1 / 2
#: Rows of a softmax, and of the sums over a window, that are computed at once.
SOFTMAX_ROWS = 384
#: Windows after which the reach of the weights is looked at anew. In between no parameter moves by more than 3.2 times the rate a window, so logits by less than 30.
LOOKED_AT, REACH = 32, 50.0
#: Tokens whose probabilities are computed at once.
SCORED_AT_ONCE = 60_000
#: Texts that are scored in step: their states stay in a core's cache.
SCORED_TEXTS = 1024
#: Bytes of text that are hashed at once, for the same reason.
HASHED_BYTES = 96 << 10
END, OTHER = 0, 1  # symbols; head words follow by falling count
#: Tokens whose states are held before the flow of a task goes on.
HELD_TOKENS = 6_000_000
#: Texts whose sums over words outside the head a task holds before it sends them on.
HELD_TEXTS = 2_000_000
LN10 = np.log(10.0)
COUNT = np.dtype([("h", "<u8"), ("c", "<i8")])
USE = np.dtype([("h", "<u8"), ("doc", "<u4"), ("n", "<u4")])
#: Of a text's words outside the head that a task has looked up: how many are known, and the logarithms of their shares of all tokens and of those outside the head.
TAIL = np.dtype([("doc", "<u4"), ("known", "<u4"), ("base", "<f8"), ("share", "<f8")])


def _bounded(w: np.ndarray, b: np.ndarray, most: float = 80) -> bool:
    """Whether exp(h @ w + b) neither overflows nor sums to 0 for any h within -1..1."""
    reach = np.abs(w).sum(-2)
    return bool((b + reach).max() < most and (b - reach).max(-1).min() > -most)


def _exps(a: np.ndarray, at: np.ndarray, fine: bool, out: np.ndarray | None, grads: bool, rows: np.ndarray | None = None) -> None:
    """Logits a become their exponents or, with grads, the gradients of the summed negative log probability of the columns that at (flat places in a) has; out gets the log probabilities added.
    rows: those that count, if not all do; the gradients of the others are 0."""
    flat = a.reshape(-1)
    if not fine:
        a -= a.max(1, keepdims=True)
    own = None if out is None else flat.take(at)
    np.exp(a, out=a)
    sums = a @ np.ones(a.shape[1], np.float32)
    if out is not None:
        out += own - np.log(sums if rows is None else sums.take(rows))
    if grads:
        scale = 1 / sums
        if rows is not None:
            scale, all_ = np.zeros_like(scale), scale
            scale[rows] = all_.take(rows)
        a *= scale[:, None]
        flat[at] -= 1


class Model:
    def __init__(self, counts: np.ndarray, seed: int = 13) -> None:
        """counts: of the symbols. Output biases start at their logarithms, so an untrained model is the unigram model."""
        rng = np.random.default_rng(seed)
        v = len(counts)
        self.size = -(-v // CLASSES)
        logs = np.log(np.asarray(counts, np.float64) + 0.5)
        logs = np.concatenate([logs, np.full(self.size * CLASSES - v, -1e9)])
        groups = logs.reshape(CLASSES, self.size)
        top = groups.max(1)
        with np.errstate(divide="ignore"):
            cls = np.where(top > -1e8, top + np.log(np.exp(groups - np.maximum(top, -1e8)[:, None]).sum(1)), -1e4)
        self.e = (rng.standard_normal((v, DIM)) * 0.1).astype(np.float32)
        parts = lambda n: np.ascontiguousarray(gru.uniform(rng, n, 3 * HIDDEN).reshape(n, 3, HIDDEN).transpose(1, 0, 2))
        # a bias is the last row of its weights: what it is added to has a last column of ones
        self.wxb = np.concatenate([parts(DIM), np.zeros((3, 1, HIDDEN), np.float32)], 1)
        self.wh = parts(HIDDEN)
        self.cwb, self.owb = np.zeros((HIDDEN + 1, CLASSES), np.float32), np.zeros((CLASSES, HIDDEN + 1, self.size), np.float32)
        self.cb[...], self.ob[...] = cls - cls.max(), np.maximum(groups - np.maximum(top, -1e8)[:, None], -1e4)

    NAMES = ("e", "wxb", "wh", "cwb", "owb")
    wx, bx = property(lambda self: self.wxb[:, :DIM]), property(lambda self: self.wxb[:, DIM:])
    cw, cb = property(lambda self: self.cwb[:HIDDEN]), property(lambda self: self.cwb[HIDDEN])
    ow, ob = property(lambda self: self.owb[:, :HIDDEN]), property(lambda self: self.owb[:, HIDDEN])

    def params(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def inputs(self) -> np.ndarray:
        return self.e @ self.wx + self.bx

    def bounded(self, most: float = 80) -> tuple[bool, bool]:
        return _bounded(self.cw, self.cb, most), _bounded(self.ow, self.ob, most)

    def log_probability(self, h: np.ndarray, y: np.ndarray, grads: list[np.ndarray] | None = None, fine: tuple[bool, bool] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """fine: what bounded() gives, where it is known. Natural log probability of symbols y after states h; with grads, those of cw, cb, ow, ob for the summed negative one are set (they are zero before), and dh is returned."""
        with_ones = np.ones((len(h), HIDDEN + 1), np.float32)
        with_ones[:, :HIDDEN] = h
        out = np.zeros(len(y), np.float32)
        if grads is None:
            return self._softmax(with_ones, y, fine or self.bounded(), out) or out, None
        c, o = np.zeros_like(self.cwb), np.zeros_like(self.owb)
        dh = self._softmax(with_ones, y, fine or self.bounded(), out, (c, o))
        for g, x in zip(grads, (c[:HIDDEN], c[HIDDEN], o[:, :HIDDEN], o[:, HIDDEN])):
            g += x
        return out, dh

    def _softmax(self, h: np.ndarray, y: np.ndarray, fine: tuple[bool, bool], out: np.ndarray | None = None, grads: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
        """Log probabilities of y after states h, which have a column of ones, are added to out; with grads, those of cwb and owb are added (they are zero before), and dh is returned.

        Rows are taken in the order of classes, the largest first, so that each one's are a slice, and in blocks that stay in a core's cache; in a block only the products are
        made class by class. States are within -1..1, so exp() needs no shift unless weights have grown very large."""
        symbol = y.astype(np.uint16)
        cls = symbol // np.uint16(self.size)
        counts = np.bincount(cls, minlength=CLASSES)
        by = np.argsort(-counts, kind="stable")
        rank = np.empty(CLASSES, np.uint8)
        rank[by] = np.arange(CLASSES)
        order = np.argsort(rank.take(cls), kind="stable")
        h, cls, within = h.take(order, 0), cls.take(order).astype(np.int64), symbol.take(order).astype(np.int64)
        within -= cls * self.size
        counts = counts[by]
        bounds, large = [0, *np.cumsum(counts).tolist()], int(np.count_nonzero(counts > TOGETHER))
        rows, places = min(len(y), SOFTMAX_ROWS), np.arange(min(len(y), SOFTMAX_ROWS))
        a, b = np.empty((rows, CLASSES), np.float32), np.empty((rows, self.size), np.float32)
        got = None if out is None else np.zeros(len(y), np.float32)
        if grads is not None:
            dh, part, cwt, owt = np.empty((len(y), HIDDEN), np.float32), np.empty((rows, HIDDEN), np.float32), self.cw.T, self.ow.transpose(0, 2, 1)
            dcwb = np.zeros((CLASSES, HIDDEN + 1), np.float32)
        for begin in range(0, len(y), SOFTMAX_ROWS):
            at = slice(begin, begin + SOFTMAX_ROWS)
            hs = h[at]
            n = len(hs)
            p = np.matmul(hs, self.cwb, out=a[:n])
            _exps(p, places[:n] * CLASSES + cls[at], fine[0], None if got is None else got[at], grads is not None)
            if grads is not None:
                dcwb += p.T @ hs
                np.matmul(p, cwt, out=dh[at])
        if grads is not None:
            grads[0][...] += dcwb.T
        for begin in range(0, bounds[large], SOFTMAX_ROWS):
            at = slice(begin, min(begin + SOFTMAX_ROWS, bounds[large]))
            hs, n = h[at], at.stop - begin
            runs = [(int(by[i]), max(bounds[i] - begin, 0), min(bounds[i + 1] - begin, n)) for i in range(large) if bounds[i] < at.stop and bounds[i + 1] > begin]
            q = b[:n]
            for k, x, z in runs:
                np.matmul(hs[x:z], self.owb[k], out=q[x:z])
            _exps(q, places[:n] * self.size + within[at], fine[1], None if got is None else got[at], grads is not None)
            if grads is not None:
                for k, x, z in runs:
                    grads[1][k] += (q[x:z].T @ hs[x:z]).T
                    np.matmul(q[x:z], owt[k], out=part[x:z])
                dh[at] += part[:n]
        # small classes are padded to the largest of their group; the rows that they lack are left out of all sums
        i, present = large, int(np.count_nonzero(counts))
        while i < present:
            most = int(counts[i])
            j = min(present, int(np.searchsorted(-counts, -(most * FILLED), "right")))
            ks, at, lanes = by[i:j], slice(bounds[i], bounds[j]), np.arange(most)
            own = np.flatnonzero(lanes < counts[i:j, None])
            hs = h.take(np.minimum(np.array(bounds[i:j])[:, None] + lanes, len(y) - 1), 0)
            w = self.owb[ks]
            q = hs @ w
            _exps(q.reshape(-1, self.size), own * self.size + within[at], fine[1], None if got is None else got[at], grads is not None, own)
            if grads is not None:
                grads[1][ks] = hs.transpose(0, 2, 1) @ q
                dh[at] += (q @ w[:, :HIDDEN].transpose(0, 2, 1)).reshape(-1, HIDDEN).take(own, 0)
            i = j
        if out is not None:
            out[order] += got
        if grads is None:
            return None
        back = np.empty_like(dh)
        back[order] = dh
        return back

    @np.errstate(over="ignore")
    def train(self, symbols: np.ndarray, epochs: int = 1, rate: float = RATE) -> None:
        """symbols: texts one after another, each closed by END. LANES streams run in step; the state is carried from window to window and begins anew after END. The last lane is filled up from the beginning."""
        if not len(symbols):
            return
        lanes = max(1, min(LANES, len(symbols) // 2000))
        n = -(-len(symbols) // lanes)
        y = np.resize(symbols, n * lanes).reshape(lanes, n).T
        y = np.ascontiguousarray(y, np.int32)
        x = np.concatenate([np.full((1, lanes), END, np.int32), y[:-1]])
        # parameters and gradients are views of one array each
        flat, grads, at = np.concatenate([p.ravel() for p in self.params()]), [], 0
        all_grads = np.zeros(len(flat) - self.e.size, np.float32)
        for name, p in zip(self.NAMES, self.params()):
            setattr(self, name, flat[at : at + p.size].reshape(p.shape))
            grads.append(all_grads[at - self.e.size : at - self.e.size + p.size].reshape(p.shape) if at else None)  # those of e come by the words that occur
            at += p.size
        adam = gru.FlatAdam(flat, rate)
        ones = np.ones((2, STEPS * lanes, DIM + 1), np.float32)  # inputs and states with a column for the biases
        # what only one step needs is kept in the same place for all, which stays in a core's cache
        proj, dproj, dstate = (np.empty((3, lanes, HIDDEN), np.float32) for _ in range(3))
        dinputs = np.empty((STEPS, lanes, DIM), np.float32)
        for epoch in range(epochs):
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t0 in range(0, n, STEPS):
                adam.rate = rate * max(0.1, 1 - (epoch * n + t0) / (epochs * n))
                xs, ys = x[t0 : t0 + STEPS], y[t0 : t0 + STEPS]
                if t0 // STEPS % LOOKED_AT == 0:
                    fine = self.bounded(REACH)
                kept, ended = [], [np.flatnonzero(s == END) for s in xs]
                inputs, states = (a[: xs.size].reshape(len(xs), lanes, -1) for a in ones)
                for t in range(len(xs)):
                    inputs[t, :, :DIM] = self.e.take(xs[t], 0)
                    h[ended[t]] = 0
                    h = gru.step_in_parts(np.matmul(inputs[t], self.wxb, out=proj), h, self.wh, kept)
                    states[t, :, :HIDDEN] = h
                all_grads.fill(0)
                dh_out = self._softmax(states.reshape(xs.size, -1), ys.ravel(), fine, None, (grads[3], grads[4])).reshape(len(xs), lanes, HIDDEN)
                dh, wht, wxt = np.zeros((lanes, HIDDEN), np.float32), np.ascontiguousarray(self.wh.transpose(0, 2, 1)), np.ascontiguousarray(self.wx.transpose(0, 2, 1))
                for t in range(len(xs) - 1, -1, -1):
                    dh += dh_out[t]
                    dh = gru.back_in_parts(dh, kept[t], wht, dproj, dstate)
                    dh[ended[t]] = 0
                    grads[2] += kept.pop()[0].T @ dstate
                    grads[1] += inputs[t].T @ dproj
                    np.sum(dproj @ wxt, 0, out=dinputs[t])
                symbol = xs.ravel().astype(np.uint16)
                order = np.argsort(symbol, kind="stable")
                used = symbol[order]
                first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
                adam.update(all_grads, 1 / ys.size, used[first], np.add.reduceat(dinputs.reshape(-1, DIM).take(order, 0), first))

    @np.errstate(over="ignore")
    def score(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text, symbols[at[i]:at[i + 1]] with END last. Texts of like length run in step, the longest first; those that have ended drop out."""
        n = np.diff(at)
        order = np.argsort(-n, kind="stable")
        proj, out, fine = self.inputs(), np.zeros(len(n)), self.bounded()
        for first in range(0, len(n), SCORED_TEXTS):
            own = order[first : first + SCORED_TEXTS]
            begin, alive = at[own], np.searchsorted(-n[own], -np.arange(1, n[own[0]] + 1), "right")
            h, last = np.zeros((len(own), HIDDEN), np.float32), np.full(len(own), END)
            states, ys, docs, held = [], [], [], 0
            for t, k in enumerate(alive):
                h = gru.step_in_parts(proj.take(last[:k], 1), h[:k], self.wh)
                last = symbols[begin[:k] + t]
                states.append(h)
                ys.append(last)
                docs.append(own[:k])
                held += k
                if held >= SCORED_AT_ONCE or t == len(alive) - 1:
                    s, y, d = np.ones((held, HIDDEN + 1), np.float32), np.concatenate(ys), np.concatenate(docs)
                    np.concatenate(states, out=s[:, :HIDDEN])
                    p = np.zeros(held, np.float32)
                    for b in range(0, held, SCORED_AT_ONCE):
                        part = slice(b, b + SCORED_AT_ONCE)
                        self._softmax(s[part], y[part], fine, p[part])
                    out += np.bincount(d, p, len(out))
                    states, ys, docs, held = [], [], [], 0
        return out / LN10


def _tokens(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in common.pieces(batch, "text"):
            words, n = zip(*((w, np.diff(at)) for w, at in (common.word_hashes(x.column(text)) for x in common.pieces(part, "text", HASHED_BYTES))))
            yield part, np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(n))])


def _by_bucket(rows: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    to = (rows["h"] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted faster
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
    return to[cut].tolist(), [x.tobytes() for x in np.split(rows, cut[1:])] if len(cut) else []


def _summed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    u, inverse = np.unique(h, return_inverse=True)
    out = np.zeros(len(u), COUNT)
    out["h"], out["c"] = u, np.bincount(inverse, c, len(u)).astype(np.int64)
    return out


def counts(training: DataFrame, buckets: int) -> DataFrame:
    """bucket, data (COUNT records by fingerprint), n_distinct, total, top (the HEAD largest): one row a bucket. Each task sends every word it has seen once."""
    parts = common.parts(training.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, words, _ in _tokens(batches, 0):
            u, c = np.unique(words, return_counts=True)
            held.append((u, c))
            size += len(u)
            if size > 4_000_000:
                one = _summed(*(np.concatenate(v) for v in zip(*held)))
                held, size = [(one["h"], one["c"])], len(one)
                if size > 2_000_000:
                    yield _rows(*_by_bucket(one, buckets))
                    held, size = [], 0
        if held:
            yield _rows(*_by_bucket(_summed(*(np.concatenate(v) for v in zip(*held))), buckets))

    def _rows(to: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(x, COUNT)
                old = held.get(k)
                held[k] = new if old is None else _summed(np.concatenate([old["h"], new["h"]]), np.concatenate([old["c"], new["c"]]))
        for k, x in held.items():
            top = x[np.lexsort((x["h"], -x["c"]))[:HEAD]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([len(x)], pa.int64()), pa.array([int(x["c"].sum())], pa.int64()), pa.array([[{"h": h, "c": c} for h, c in zip(top["h"].view(np.int64).tolist(), top["c"].tolist())]], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))], ["bucket", "data", "n_distinct", "total", "top"])

    sent = training.select("text").mapInArrow(common.released(count), "bucket long, data binary").repartition(parts, "bucket")
    return common.materialize(sent.mapInArrow(common.released(reduce), "bucket long, data binary, n_distinct long, total long, top array<struct<h: long, c: long>>"), "counts")


class Head:
    """Symbols of word fingerprints."""

    def __init__(self, top: list) -> None:
        h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
        self.order = np.argsort(h)
        self.h, self.c = h[self.order], np.array([r["c"] for r in top], np.int64)
        self.begins = None

    def symbols(self, words: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(words), OTHER)
        if self.begins is None:  # where the fingerprints with the same first 16 bits begin; there are few of each
            self.begins = np.searchsorted(self.h >> np.uint64(48), np.arange((1 << 16) + 1).astype(np.uint64)).astype(np.int32)
            self.n = np.diff(self.begins)
        first = (words >> np.uint64(48)).astype(np.int32)
        at = np.minimum(self.begins.take(first), len(self.h) - 1)
        out = np.where(self.h.take(at) == words, self.order.take(at) + 2, OTHER)
        n, k = self.n.take(first), 1
        left = np.flatnonzero(n > 1)
        while len(left):
            place = at[left] + k
            same = self.h[place] == words[left]
            out[left[same]] = self.order[place[same]] + 2
            k += 1
            left = left[n[left] > k]
        return out


def _with_ends(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(symbols) + len(at) - 1, END)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[np.arange(len(symbols)) + doc] = symbols
    return out, at + np.arange(len(at))


def trained(training: DataFrame, head: Head, model: Model, tokens: int) -> Model:
    """model after training on all texts. The first shard warms it up; then all shards start from that, and their parameters are averaged in the proportion of their tokens."""
    shards = max(1, tokens // SHARD_TOKENS)
    tasks = min(shards, 4 * common.parts(training.sparkSession))
    epochs = max(1, min(MAX_EPOCHS, EPOCH_TOKENS // max(tokens, 1)))
    mine = training.select("text", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(shards)).alias("shard"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The symbols of a shard's texts one after another, 2 bytes each."""
        for part, words, at in _tokens(batches, 0):
            s, at = _with_ends(head.symbols(words).astype("<u2"), at)
            s, shard = s.astype("<u2"), part.column(1).to_numpy()
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order])) + 1
            data = [np.concatenate([s[at[i] : at[i + 1]] for i in own]).tobytes() for own in np.split(order, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][np.concatenate([[0], cut])], pa.int64()), pa.array(data, pa.binary())], ["shard", "data"])

    def learn(start: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Trains on one shard after another; gives the mean of the task's shards, by tokens, and how many tokens they have."""
            total, weight, first, held = 0.0, 0.0, None, []

            def shard() -> None:
                nonlocal total, weight
                m = Model.__new__(Model)
                m.__dict__ |= {n: v.copy() if isinstance(v, np.ndarray) else v for n, v in start.__dict__.items()}
                stream = np.frombuffer(b"".join(held), "<u2")
                held.clear()
                texts = np.split(stream, np.flatnonzero(stream == END) + 1)
                stream = np.concatenate(sorted(texts, key=lambda x: x.tobytes())).astype(np.int64)
                m.train(stream, epochs)
                total = total + len(stream) * np.concatenate([p.ravel() for p in m.params()]).astype(np.float64)
                weight += len(stream)

            last = None
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if held and k != last:
                        shard()
                    first, last = k if first is None else first, k
                    held.append(x)
            if held:
                shard()
                for c, x in enumerate(np.array_split((total / weight).astype(np.float32), 16)):
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([first], pa.int64()), pa.array([weight]), pa.array([x.tobytes()], pa.binary())], ["chunk", "shard", "weight", "data"])

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for c, w, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s = sums.setdefault(c, [0.0, 0.0])
                s[0] += w
                s[1] = s[1] + w * np.frombuffer(x, np.float32).astype(np.float64)
        for c, (w, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(s / w).astype(np.float32).tobytes()], pa.binary())], ["chunk", "data"])

    for rows in (mine.where("shard = 0"), mine) if shards > 1 else (mine,):
        sent = rows.mapInArrow(common.released(send), "shard long, data binary").repartition(1 if rows is not mine else tasks, "shard").sortWithinPartitions("shard")
        sent = sent.mapInArrow(common.released(learn(model)), "chunk int, shard long, weight double, data binary").repartition(16, "chunk").sortWithinPartitions("chunk", "shard")
        got = sent.mapInArrow(common.released(average), "chunk int, data binary").collect()  # one model
        if len(got) == 16:
            flat = np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(got, key=lambda r: r["chunk"])])
            at = 0
            for p in model.params():
                p[...] = flat[at : at + p.size].reshape(p.shape)
                at += p.size
    return model


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs.

    A null or empty text is its end alone. Rows whose id is in the held-out fold are scored but not learnt from; a null id is in no fold and is learnt from.
    Rows that repeat are all counted and all scored. Without any training text the counts are 0 and every word is unknown.
    """
    spark = docs.sparkSession
    common.tune(spark)
    plain = docs.select(F.col(doc_id).alias("doc_id"), common.fold(FOLDS, F.col(doc_id)).eqNullSafe(HELD_OUT).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = plain.where(~F.col("held_out")).select("doc_id", "text")
    parts = common.parts(spark)
    buckets = 4 * parts
    counted = counts(training, buckets)
    words, distinct = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    ends = training.count()
    total, kinds = words + ends, distinct + (ends > 0)
    top = counted.select(F.explode("top").alias("t")).select("t.h", "t.c").orderBy(F.desc("c"), "h").limit(HEAD).collect()
    head = Head(top)
    tail_total, tail_kinds = words - int(head.c.sum()), distinct - len(top)
    by_symbol = np.concatenate([[ends, tail_total], head.c])
    model = trained(training, head, Model(by_symbol), total)
    base = np.log10((by_symbol + 0.5) / (total + 0.5 * (kinds + 1)))
    shared = spark.sparkContext.broadcast((model, head.h, head.order, head.c))  # bounded by HEAD

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, h, order, c = shared.value
        own = Head([])
        own.h, own.order, own.c = h, order, c
        flow, held, size = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flow, held, size
            if not held:
                return
            ident = TaskContext.get().partitionId() * (1 << 20) + flow
            symbols = np.concatenate([s for _, s, _, _ in held])
            at = np.concatenate([[0], np.cumsum(np.concatenate([n for _, _, n, _ in held]))])
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            known = (symbols != OTHER) & ((symbols != END) | (ends > 0))
            figures = {
                "n_tokens": np.diff(at), "n_known": np.bincount(doc, known, len(at) - 1).astype(np.int64), "score": net.score(symbols, at),
                "base_score": np.bincount(doc, np.where(symbols != OTHER, base[symbols], 0.0), len(at) - 1),
            }
            table = pa.Table.from_batches([r for r, _, _, _ in held])
            for name, x in figures.items():
                table = table.append_column(name, pa.array(x))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            uses = np.concatenate([u for _, _, _, u in held])
            to, data = _by_bucket(uses, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([*to, ident % buckets], pa.int64()), pa.array([1] * len(to) + [2], pa.int32()), pa.array([ident] * (len(to) + 1), pa.int64()), pa.array([*data, sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "kind", "flow", "data"])
            flow, held, size = flow + 1, [], 0

        docs_held = 0
        for part, hashes, at in _tokens(batches, 2):
            s = own.symbols(hashes)
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))
            other = s == OTHER
            uses = np.zeros(int(other.sum()), USE)
            uses["h"], uses["doc"], uses["n"] = hashes[other], doc[other] + docs_held, 1
            symbols, ends_at = _with_ends(s.astype(np.int32), at)
            held.append((part.select(["doc_id", "held_out"]), symbols, np.diff(ends_at), uses))
            size += len(symbols)
            docs_held += part.num_rows
            if size >= HELD_TOKENS:
                yield from flush()
                docs_held = 0
        yield from flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, size = None, np.zeros(0, COUNT), 0
        sums: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for flow, s in sums.items():
                doc = np.flatnonzero(s[1])
                out = np.zeros(len(doc), TAIL)
                out["doc"], out["known"], out["base"], out["share"] = doc, s[0, doc], s[1, doc], s[2, doc]
                yield pa.RecordBatch.from_arrays([pa.array([flow], pa.int64()), pa.array([1], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["flow", "kind", "data"])
            sums.clear()
            size = 0

        for batch in batches:
            for b, kind, flow, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    bucket, table = b, np.zeros(0, COUNT)
                if kind == 0:
                    table = np.frombuffer(x, COUNT)
                elif kind == 2:
                    yield pa.RecordBatch.from_arrays([pa.array([flow], pa.int64()), pa.array([2], pa.int32()), pa.array([x], pa.binary())], ["flow", "kind", "data"])
                else:
                    uses = np.frombuffer(x, USE)
                    at = np.minimum(np.searchsorted(table["h"], uses["h"]), max(len(table) - 1, 0))
                    c = np.where(table["h"][at] == uses["h"], table["c"][at], 0) if len(table) else np.zeros(len(uses))
                    n = int(uses["doc"].max()) + 1
                    old = sums.get(flow)
                    size += n - (0 if old is None else min(n, old.shape[1]))
                    own = np.stack([np.bincount(uses["doc"], v, n) for v in (c > 0, np.log10((c + 0.5) / (total + 0.5 * (kinds + 1))), np.log10((c + 0.5) / (tail_total + 0.5 * (tail_kinds + 1))))])
                    if old is not None and old.shape[1] < n:
                        old, own = own, old
                    if old is not None:
                        old[:, : own.shape[1]] += own
                    sums[flow] = own if old is None else old
                    if size > HELD_TEXTS:
                        yield from flush()
        yield from flush()

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, pa.Table] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for flow, kind, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == 2:
                    tables[flow] = pa.ipc.open_stream(x).read_all()
                    continue
                own = np.frombuffer(x, TAIL)  # a text is in it once
                old = sums.get(flow, np.zeros((3, 0)))
                if len(own) and old.shape[1] <= own["doc"][-1]:
                    old = np.pad(old, ((0, 0), (0, int(own["doc"][-1]) + 1 - old.shape[1])))
                for k, name in enumerate(("known", "base", "share")):
                    old[k, own["doc"]] += own[name]
                sums[flow] = old
        for flow, t in tables.items():
            s = np.zeros((3, t.num_rows))
            if flow in sums:
                s[:, : sums[flow].shape[1]] = sums[flow]
            n = t.num_rows
            yield from pa.table(
                [t["doc_id"], t["held_out"], t["n_tokens"], pa.array(t["n_known"].to_numpy() + s[0].astype(np.int64)), pa.array(np.full(n, total)), pa.array(t["base_score"].to_numpy() + s[1]), pa.array(t["score"].to_numpy() + s[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ).combine_chunks().to_batches()

    tables = counted.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("flow"), "data")
    sent = plain.mapInArrow(common.released(first), "bucket long, kind int, flow long, data binary").union(tables)
    sent = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(common.released(second), "flow long, kind int, data binary")
    schema = T.StructType([docs.select(F.col(doc_id).alias("doc_id")).schema[0], T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return sent.repartition(parts, "flow").mapInArrow(common.released(third), schema)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
