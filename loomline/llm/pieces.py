"""SentencePiece encoding and decoding by weighted transducers.

The model compiles into a normaliser (spaces become U+2581, with one in front), a lexicon transducer (a trie of pieces, with an arc of bytes for any character
that no piece covers) and arc weights. A text is composed with it by walking the trie from every position at once; the arcs found are a lattice, whose
tropical shortest path is the encoding. For a unigram model an arc weighs minus its piece's score. A BPE model's merges are expressed by the lattice's states:
two pieces may stand side by side only where merging them as one text gives just these two, and then only one path is left, that of the merges.

No piece has U+2581 after another character, so a path has a node at each word's begin, and equal words (with the spaces before them) are encoded once.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
MARK_BYTES = MARK.encode()
UNIGRAM, BPE = 1, 2
NORMAL, BYTE = 1, 6
#: Pairs of pieces whose compatibility has a place of its own: 2**PAIR_BITS.
PAIR_BITS = 22
#: Encoded words that a worker keeps.
CACHED_WORDS = 1_000_000
#: Where the public vocabulary is on this machine; every executor needs it there, or pass the model's bytes.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; 32-bit values are bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, their scores and kinds, and the normaliser's settings. ValueError for what isn't handled: a table of character rules, or pieces that users defined."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[bytes] = []
        scores, kinds = [], []
        self.type, self.prefix, self.trim, self.escape, self.fallback = UNIGRAM, True, True, True, False
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b""))
                scores.append(struct.unpack("<f", f.get(2, bytes(4)))[0])
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.type, self.fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("character rules are not handled")
                self.prefix, self.trim, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if 4 in kinds or self.type not in (UNIGRAM, BPE) or not self.escape:
            raise ValueError("a model of this kind is not handled")
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        self.unknown = kinds.index(2)
        self.byte_ids = np.array([self.pieces.index(b"<0x%02X>" % b) for b in range(256)] if self.fallback else [self.unknown] * 256)
        self.by_words = not any(MARK_BYTES in p.lstrip(MARK_BYTES) for p, k in zip(self.pieces, kinds) if k == NORMAL)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self._compile()
        self._pairs, self._pair_ok, self._others = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool), {}
        self._forget()
        self.made = np.ones(len(self.pieces) + 1, bool)
        if self.type == BPE:
            for p, i in self.ids.items():
                self.made[i] = len(self.merged(p)) == 1
        self.shown = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == 3 else p for p, k in zip(self.pieces, kinds)]

    def _compile(self) -> None:
        """The trie as sorted keys (state * 256 + byte) and the states they lead to; final[state] is the piece that ends there."""
        nodes: dict[int, int] = {}
        final = {}
        for p, i in self.ids.items():
            state = 0
            for b in p:
                state = nodes.setdefault(state * 256 + b, len(nodes) + 1)
            final[state] = i
        keys = np.array(sorted(nodes), np.int64)
        self.arcs, self.to = keys, np.array([nodes[k] for k in keys.tolist()], np.int64)
        self.final = np.full(len(nodes) + 1, -1)
        self.final[list(final)] = list(final.values())

    def lattice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every arc over the words data[at[i]:at[i + 1]]. A character without a piece has an arc with piece -1."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        limit = at[np.searchsorted(at, starts, "right")]
        place, state, own = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts))
        begins, ends, ids = [], [], []
        while len(own):
            key = state * 256 + data[place]
            k = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            go = self.arcs[k] == key
            own, state, place = own[go], self.to[k[go]], place[go] + 1
            done = self.final[state] >= 0
            begins.append(starts[own[done]])
            ends.append(place[done])
            ids.append(self.final[state[done]])
            more = place < limit[own]
            own, state, place = own[more], state[more], place[more]
        begin, end, piece = (np.concatenate(x) for x in (begins, ends, ids))
        following = np.append(starts[1:], len(data))
        covered = np.zeros(len(data) + 1, bool)
        one = end == following[np.searchsorted(starts, begin)] if len(begin) else np.zeros(0, bool)
        covered[begin[one]] = True
        bare = np.flatnonzero(~covered[starts])
        return np.concatenate([begin, starts[bare]]), np.concatenate([end, following[bare]]), np.concatenate([piece, np.full(len(bare), -1)])

    def merged(self, text: bytes) -> list[bytes]:
        """What merging by score, the leftmost first, makes of a text."""
        parts = [c.encode() for c in text.decode()]
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces may stand side by side; -1 (a text's begin, or a character without a piece) goes with all. Answers are kept for later texts."""
        key = left * len(self.pieces) + right
        out = (left < 0) | (right < 0)
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        miss = (self._pairs[slot] != key) & ~out
        if miss.any():
            for k in np.unique(key[miss]).tolist():
                a, b = (self.pieces[x] for x in divmod(k, len(self.pieces)))
                at = (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - PAIR_BITS
                if self._pairs[at] < 0:
                    self._pairs[at], self._pair_ok[at] = k, self.merged(a + b) == [a, b]
                else:  # the place is taken
                    if k not in self._others:
                        self._others[k] = self.merged(a + b) == [a, b]
        found = self._pairs[slot] == key
        out |= found & self._pair_ok[slot]
        rest = np.flatnonzero(~found & (left >= 0) & (right >= 0))
        if len(rest):
            out[rest] = [self._others[k] for k in key[rest].tolist()]
        return out

    def shortest(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words in order (a character without a piece gives its bytes' pieces, or the unknown one), and where each word's begin."""
        begin, end, piece = self.lattice(data, at)
        if self.type == BPE:  # a piece that merging can't make is on no path
            keep = self.made[piece]
            begin, end, piece = begin[keep], end[keep], piece[keep]
        word = np.searchsorted(at, begin, "right") - 1
        depth = end - at[word]
        order = np.argsort(depth.astype(np.uint16) if not len(depth) or depth.max() < 1 << 16 else depth, kind="stable")
        begin, end, piece, depth = begin[order], end[order], piece[order], depth[order]
        cost = np.full(len(data) + 1, np.inf)
        last, source = np.full(len(data) + 1, -1), np.full(len(data) + 1, -1)
        # words touch, so a node is named by the byte before it, and a word's first node by none
        weight = np.where(piece >= 0, -self.scores[piece], 1e4 - self.scores.min()) if self.type == UNIGRAM else np.zeros(len(piece))
        first = np.zeros(len(data) + 1, bool)
        first[at[:-1]] = True
        bounds = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]])) if len(depth) else np.zeros(0, int)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            b, e, p, w = begin[lo:hi], end[lo:hi], piece[lo:hi], weight[lo:hi]
            initial = first[b]
            before = np.where(initial, 0.0, cost[b])
            if self.type == BPE:
                ok = np.isfinite(before)
                ok[ok] = self.compatible(np.where(initial, -1, last[b])[ok], p[ok])
                before = np.where(ok, before, np.inf)
            total = before + w
            good = np.isfinite(total)
            b, e, p, total = b[good], e[good], p[good], total[good]
            if self.type == BPE:  # one piece at most
                best = slice(None)
            else:
                best = np.lexsort((total, e))
                best = best[np.concatenate([[True], e[best][1:] != e[best][:-1]])] if len(best) else best
            cost[e[best]], last[e[best]], source[e[best]] = total[best], p[best], b[best]
        node, words, steps = at[1:].copy(), np.arange(len(at) - 1), []
        keep = at[1:] > at[:-1]
        node, words = node[keep], words[keep]
        while len(node):
            steps.append((words, source[node], last[node], node))
            node = source[node]
            more = ~first[node]
            node, words = node[more], words[more]
        w, b, p, e = (np.concatenate([s[i] for s in steps]) if steps else np.zeros(0, np.int64) for i in range(4))
        order = np.lexsort((b, w))
        w, b, p, e = w[order], b[order], p[order], e[order]
        n = np.where(p >= 0, 1, (e - b) if self.fallback else 1)
        out = np.repeat(p, n)
        offset = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        spelled = out < 0
        out[spelled] = self.byte_ids[data[(np.repeat(b, n) + offset)[spelled]]]
        return out, np.searchsorted(np.repeat(w, n), np.arange(len(at)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin."""
        data, at = common.text_buffer(texts)
        n = len(at) - 1
        raw = data.tobytes()
        if self.trim or not self.prefix or not self.by_words:
            words, of = [], []
            for i in range(n):
                t = raw[at[i] : at[i + 1]]
                t = b" ".join(t.split(b" ")) if not self.trim else b" ".join(x for x in t.split(b" ") if x)
                if t:
                    words.append((b" " if self.prefix else b"") + t)
                    of.append(i)
            return self._by_word(words, np.array(of, np.int64), n)
        # a word begins at a space that follows another character, and at a text's begin; there the normaliser puts one space more
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        heads = np.unique(at[:-1][np.diff(at) > 0])
        start[heads] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        of = np.searchsorted(at, begin, "right") - 1
        head = np.zeros(len(data), bool)
        head[heads] = True
        h = common.span_hashes(common.prefix_sums(data), begin, end) ^ head[begin].astype(np.uint64)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self._known) > CACHED_WORDS:
            self._forget()
        k = np.minimum(np.searchsorted(self._known, distinct), max(len(self._known) - 1, 0))
        new = self._known[k] != distinct if len(self._known) else np.ones(len(distinct), bool)
        if new.any():
            words = [(b" " if head[b] else b"") + raw[b:e] for b, e in zip(begin[first[new]].tolist(), end[first[new]].tolist())]
            ids, word_at = self._words(words)
            place = np.searchsorted(self._known, distinct[new])
            self._known = np.insert(self._known, place, distinct[new])
            self._at = np.insert(self._at, place, word_at[:-1] + len(self._ids))
            self._size = np.insert(self._size, place, np.diff(word_at))
            self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        k = np.searchsorted(self._known, distinct)
        size, word_begin = self._size[k][inverse], self._at[k][inverse]
        out = self._ids[np.repeat(word_begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        return out, np.searchsorted(np.repeat(of, size), np.arange(n + 1))

    def _forget(self) -> None:
        """Empties the table of encoded words, by fingerprint; it only saves time."""
        self._known, self._at, self._size, self._ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marked = [w.replace(b" ", MARK_BYTES) for w in words]
        at = np.cumsum([0, *map(len, marked)])
        return self.shortest(np.frombuffer(b"".join(marked), np.uint8), at)

    def _by_word(self, words: list[bytes], of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self._words(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        return ids, np.searchsorted(np.repeat(of, np.diff(at)), np.arange(n + 1))

    def decode(self, ids: list[int]) -> bytes:
        """The text of some ids, as UTF-8. U+2581 becomes a space; the one that encoding puts in front goes."""
        out = b"".join([self.shown[i] for i in ids]).replace(MARK_BYTES, b" ")
        return out[1:] if self.prefix and out[:1] == b" " else out


_loaded: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded[key] = Model(data)
    return _loaded[key]


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model_path: str = MODEL_PATH, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_spelled (byte pieces), ids_sha256 (of 32-bit little-endian ids), decoded_sha256, roundtrip and, with keep_ids, ids.

    The driver reads the model once (under a MB, it goes with the task). A null or empty text has no pieces. roundtrip is false only for texts that hold U+2581
    themselves. Other columns of docs play no part; rows that repeat stay.
    """
    common.tune(docs.sparkSession)
    with open(model_path, "rb") as f:
        data = f.read()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = [("n_bytes", T.LongType()), ("n_pieces", T.LongType()), ("n_spelled", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("roundtrip", T.BooleanType())]
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(*k) for k in kinds], *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        is_byte = model.kinds == BYTE
        for batch in batches:
            for part in common.pieces(batch, "text"):
                raw, at = common.text_buffer(part.column(1))
                raw = raw.tobytes()
                ids, to = model.encode(part.column(1))
                spelled = np.concatenate([[0], np.cumsum(is_byte[ids])])
                ids = ids.astype("<i4")
                sha, back, same = [], [], []
                for i in range(part.num_rows):
                    own = ids[to[i] : to[i + 1]]
                    text_ = model.decode(own.tolist())
                    sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                    back.append(hashlib.sha256(text_).hexdigest())
                    same.append(text_ == raw[at[i] : at[i + 1]])
                columns = [part.column(0), pa.array(np.diff(at)), pa.array(np.diff(to)), pa.array(np.diff(spelled[to])), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(common.released(run), schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.documents(spark, sf_dir), keep_ids=False)
