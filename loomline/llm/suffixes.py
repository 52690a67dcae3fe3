"""Removal of long repeated passages by a logarithmic family of sparse suffix arrays.

A window is a string of `length` bytes. Its anchor is the position of its smallest fingerprint of half its length, so equal windows have equal anchors
wherever they stand, and neighbouring windows share one. The suffix at an anchor, with the windows that share it (a run), is one entry of a suffix array.
Entries are in the order of the fingerprints of what they begin with, not of its bytes: any order in which equal prefixes are neighbours shows the same long
matches, and fingerprints need 8 bytes where the prefixes need hundreds.

Each task that holds a part of the fingerprints takes batches as they come: a batch is sorted, merge-scanned against every level of the family, and added as
a level; levels of equal size are merged, so there are logarithmically many. Runs that match in full are repeated. Where runs share an anchor but not all of
their text, a second family of their single windows decides. A map task sends one entry of each kind it has seen, so a passage that all documents share is no
larger in any task than the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: An entry: fingerprint of the anchor, fingerprint of the run's text, document, first window, number of windows, flags.
ENTRY = np.dtype([("m", "<u8"), ("c", "<u8"), ("key", "<i8"), ("s", "<u4"), ("n", "<u4"), ("flag", "<u1")])
REPEATED, CONTESTED, KNOWN = 1, 2, 4
#: Kinds of spans: found to be repeated; to be looked at window by window; its windows are repeated and stand for others.
FOUND, OPEN, WITNESS = 0, 1, 2
RECORD = np.dtype([("key", "<i8"), ("kind", "<u4"), ("s", "<u4"), ("n", "<u4")])
SPAN = np.dtype([("kind", "<u4"), ("s", "<u4"), ("n", "<u4")])
POSITION = np.uint64((1 << 28) - 1)
#: Words of the shortest passage that is told of beside what is removed: over 50, of which many have fewer than 400 bytes.
PASSAGE_WORDS = 51
#: Windows of a longer text that are worked on at once.
SLICE = 1 << 22
#: Rows of packed entries in a batch that a task sends.
SENT_ROWS = 16
#: Rows and bytes up to which the documents found are sent to all tasks instead of being joined by a shuffle.
SEND_ROWS, SEND_BYTES = 1_000_000, 16 << 20


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _units(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What windows are counted in: the bytes of all texts or fingerprints of their words, and where each text's begin."""
    return common.word_hashes(texts, fold=False) if words else common.text_buffer(texts)


def runs(data: np.ndarray, at: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """The entries of all documents of a piece."""
    if len(data) < length:
        return np.zeros(0, ENTRY)
    k = length // 2
    sums = common.prefix_sums(data)
    i = np.arange(len(data) - k + 1)
    h = common.span_hashes(sums, i, i + k)
    anchor = (_sliding_min((h & ~POSITION) | i.astype(np.uint64), length - k + 1) & POSITION).astype(np.int64)
    begin, end = at[:-1], np.maximum(at[1:] - length + 1, at[:-1])  # windows of each document
    inside = np.zeros(len(anchor) + 1, np.int64)
    np.add.at(inside, np.minimum(begin, len(anchor)), 1)
    np.add.at(inside, np.minimum(end, len(anchor)), -1)
    s = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(s):
        return np.zeros(0, ENTRY)
    a = anchor[s]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.append(first[1:], len(s)) - 1
    doc = np.searchsorted(at, s[first], "right") - 1
    out = np.zeros(len(first), ENTRY)
    out["m"], out["c"] = h[a[first]], common.span_hashes(sums, s[first], s[last] + length)
    out["key"], out["s"], out["n"] = keys[doc], s[first] - at[doc], last - first + 1
    return out


def _identity(e: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(common.mix(e["m"]) + e["c"])


def _combined(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry of each (m, c) of a task, and the others that are repeated; a document's copies (same key and place) count once."""
    e = e[np.lexsort((e["s"], e["key"], e["c"], e["m"]))]
    if len(e):
        same = (e["m"][1:] == e["m"][:-1]) & (e["c"][1:] == e["c"][:-1])
        again = same & (e["key"][1:] == e["key"][:-1]) & (e["s"][1:] == e["s"][:-1])
        first = np.concatenate([[True], ~same])
        group = np.cumsum(first) - 1
        copies = np.bincount(group, np.concatenate([[True], ~again])) > 1
        # of copies the one that is not a witness goes on
        known = np.zeros(len(copies), bool)
        np.logical_or.at(known, group, (e["flag"] & KNOWN) > 0)
        found = copies[group] & np.concatenate([[True], ~again]) & ((e["flag"] & KNOWN) == 0)
        lone = first.copy()
        kept = e[lone].copy()
        kept["flag"] |= np.where(copies, REPEATED | KNOWN, 0).astype(np.uint8) | np.where(known, KNOWN | REPEATED, 0).astype(np.uint8)
        # a witness's text is repeated: what stands beside it in this task is, too
        found |= (known[group] & ~copies[group] & ((e["flag"] & KNOWN) == 0)) & np.concatenate([[True], ~again])
        return kept, e[found]
    return e, e


class Level:
    """Sorted entries, and their (m, c) in the order of one number for both."""

    def __init__(self, e: np.ndarray) -> None:
        self.e = e[np.lexsort((e["c"], e["m"]))]
        self.m = np.ascontiguousarray(self.e["m"])
        own = _identity(self.e)
        self.order = np.argsort(own)
        self.ids = own[self.order]


def _between(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.flatnonzero(np.cumsum(d[:-1]))


class Family:
    """Levels of sorted entries, each at least twice as long as the next. What comes in small parts is held until it is worth a level."""

    def __init__(self, least: int = 50_000) -> None:
        self.levels: list[Level] = []
        self.held: list[np.ndarray] = []
        self.least = least

    def add(self, entries: np.ndarray) -> None:
        self.held.append(entries)
        if sum(map(len, self.held)) >= self.least:
            self._close()

    def _close(self) -> None:
        if not self.held:
            return
        batch = self._scan_self(np.concatenate(self.held))
        self.held = []
        for level in self.levels:
            batch = self._scan(batch, level)
        self.levels.append(Level(batch))
        while len(self.levels) > 1 and 2 * len(self.levels[-1].e) >= len(self.levels[-2].e):
            self.levels.append(Level(np.concatenate([self.levels.pop().e, self.levels.pop().e])))

    @staticmethod
    def _scan_self(b: np.ndarray) -> np.ndarray:
        """Sorted, with marks on what its parts have in common; of entries for one document and place one stays."""
        b = b[np.lexsort((b["s"], b["key"], b["c"], b["m"]))]
        if len(b) > 1:
            same_m = b["m"][1:] == b["m"][:-1]
            same = same_m & (b["c"][1:] == b["c"][:-1])
            again = same & (b["key"][1:] == b["key"][:-1]) & (b["s"][1:] == b["s"][:-1])
            by_m, by_c = np.cumsum(np.concatenate([[True], ~same_m])) - 1, np.cumsum(np.concatenate([[True], ~same])) - 1
            contested = np.bincount(by_m, np.concatenate([[False], same_m & ~same])) > 0
            repeated = np.bincount(by_c, np.concatenate([[False], same & ~again])) > 0
            # what is known of one entry is known of its copies
            place = np.cumsum(np.concatenate([[True], ~again])) - 1
            known = np.bincount(place, (b["flag"] & KNOWN) > 0) > 0
            flags = np.where(contested[by_m], CONTESTED, 0) | np.where(repeated[by_c], REPEATED, 0) | np.where(known[place], KNOWN | REPEATED, 0)
            b["flag"] |= flags.astype(np.uint8)
            b = b[np.concatenate([[True], ~again])]
        return b

    @staticmethod
    def _scan(batch: np.ndarray, level: Level) -> np.ndarray:
        """Marks what batch and level have in common, in both; entries of batch that level has itself (same document and place) go."""
        e = level.e
        if not len(e) or not len(batch):
            return batch
        m = np.ascontiguousarray(batch["m"])
        lo, hi = np.searchsorted(level.m, m), np.searchsorted(level.m, m, "right")
        near = np.flatnonzero(hi > lo)  # the rest has nothing in common with level
        own = _identity(batch[near])
        glo, ghi = np.searchsorted(level.ids, own), np.searchsorted(level.ids, own, "right")
        at = level.order[np.minimum(glo, len(e) - 1)]
        itself = (ghi - glo == 1) & (e["key"][at] == batch["key"][near]) & (e["s"][at] == batch["s"][near])
        match = (ghi > glo) & ~itself
        e["flag"][level.order[_between(glo[match], ghi[match], len(e))]] |= REPEATED
        e["flag"][at[itself]] |= batch["flag"][near[itself]]
        batch["flag"][near[match]] |= REPEATED
        contested = (hi - lo)[near] > ghi - glo
        batch["flag"][near[contested]] |= CONTESTED
        e["flag"][_between(lo[near[contested]], hi[near[contested]], len(e))] |= CONTESTED
        stay = np.ones(len(batch), bool)
        stay[near[itself]] = False
        return batch[stay]

    def result(self) -> np.ndarray:
        self._close()
        e = np.concatenate([np.zeros(0, ENTRY), *(x.e for x in self.levels)])
        return e[np.lexsort((e["c"], e["m"]))]


def _records(e: np.ndarray, kind: np.ndarray | int, buckets: int) -> pa.RecordBatch:
    """Results packed by bucket of their documents, so that there are few rows however many documents and tasks there are."""
    out = np.zeros(len(e), RECORD)
    out["key"], out["kind"], out["s"], out["n"] = e["key"], kind, e["s"], e["n"]
    to = e["key"] % buckets
    order = np.argsort(to, kind="stable")
    out, to = out[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
    return pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int64()), pa.array([x.tobytes() for x in np.split(out, cut[1:])] if len(cut) else [], pa.binary())], ["bucket", "data"])


def _by_document(found: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """key, packed: SPAN records of each document that has one of the kinds; spans of kind FOUND that touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, RECORD) for batch in batches for x in batch.column(1).to_pylist()]
        r = np.concatenate([np.zeros(0, RECORD), *held])
        r = r[np.isin(r["kind"], kinds)]
        r = r[np.lexsort((r["s"], r["kind"], r["key"]))]
        if not len(r):
            return
        joins = (r["kind"][1:] == FOUND) & (r["kind"][:-1] == FOUND) & (r["key"][1:] == r["key"][:-1]) & (r["s"][1:] <= r["s"][:-1] + r["n"][:-1])
        first = np.flatnonzero(np.concatenate([[True], ~joins]))
        out = np.zeros(len(first), SPAN)
        out["kind"], out["s"] = r["kind"][first], r["s"][first]
        out["n"] = np.maximum.reduceat(r["s"] + r["n"], first) - out["s"]
        keys = r["key"][first]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        packed = [x.tobytes() for x in np.split(out, cut[1:])]
        for b in range(0, len(cut), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut[b : b + 4096]]), pa.array(packed[b : b + 4096], pa.binary())], ["key", "packed"])

    return found.repartitionById(common.parts(found.sparkSession), F.col("bucket").cast("int")).mapInArrow(common.released(run), "key long, packed binary")


def _outcome(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries to tell of, and their kinds."""
    if not len(e):
        return e, np.zeros(0, np.uint32)
    repeated = (e["flag"] & REPEATED) > 0
    found = repeated & ((e["flag"] & KNOWN) == 0)
    first_m = np.concatenate([[True], e["m"][1:] != e["m"][:-1]])
    group = np.cumsum(first_m) - 1
    open_ = ~repeated & ((e["flag"] & CONTESTED) > 0)
    asked = np.bincount(group, open_) > 0
    first = first_m | np.concatenate([[True], e["c"][1:] != e["c"][:-1]])
    witness = repeated & first & asked[group]
    parts = [(e[found], FOUND), (e[open_], OPEN), (e[witness], WITNESS)]
    return np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k, np.uint32) for p, k in parts])


def _indexed(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[np.ndarray]], label: str) -> DataFrame:
    """bucket, data: RECORDs of what the families have found. rows go through entries() task by task; its entries are dealt by fingerprint, results by document."""
    spark = rows.sparkSession
    buckets = common.parts(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [e for batch in batches for e in entries(batch)]
        kept, found = _combined(np.concatenate([np.zeros(0, ENTRY), *held]))
        del held
        to = (kept["m"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        kept, to = kept[order], to[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
        parts = np.split(kept, cut[1:]) if len(cut) else []
        for b in range(0, len(parts), SENT_ROWS):
            own = [x.tobytes() for x in parts[b : b + SENT_ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut[b : b + SENT_ROWS]], pa.int64()), pa.array([False] * len(own)), pa.array(own, pa.binary())], ["bucket", "result", "data"])
        done = _records(found, FOUND, buckets)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(0), pa.array([True] * done.num_rows), done.column(1)], ["bucket", "result", "data"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for batch in batches:
            direct = batch.filter(batch.column(1))
            if direct.num_rows:
                yield pa.RecordBatch.from_arrays([direct.column(0), direct.column(2)], ["bucket", "data"])
            for x in batch.filter(pc.invert(batch.column(1))).column(2).to_pylist():
                family.add(np.frombuffer(x, ENTRY))
        out = _records(*_outcome(family.result()), buckets)
        if out.num_rows:
            yield out

    sent = rows.mapInArrow(common.released(send), "bucket long, result boolean, data binary").repartitionById(buckets, F.col("bucket").cast("int"))
    return common.materialize(sent.mapInArrow(common.released(index), "bucket long, data binary"), label)


def _with_spans(docs: DataFrame, spans: DataFrame, how: str, packed: tuple[str, ...] = ("packed",)) -> DataFrame:
    """docs joined with key, spans: sent to all tasks if few and short, which is looked up first; else both sides are shuffled."""
    length = sum((F.coalesce(F.length(c), F.lit(0)) for c in packed), F.lit(0))
    size = spans.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return docs.join(F.broadcast(spans) if size[0] <= SEND_ROWS and size[1] <= SEND_BYTES else spans, "key", how)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, SPAN)


def repeats(docs: DataFrame, text: str = "text", length: int = 400, words: bool = False) -> DataFrame:
    """key, packed, copies: for each text that has repeated windows their starts (SPAN records of kind FOUND); copies is how many rows have the text.

    key is xxhash64 of the text. Only texts of at least `length` bytes can have any; with words=True windows, starts and `length` are counted in words.
    """
    least = 2 * length - 1 if words else length  # bytes of the shortest window
    source = docs.select(F.xxhash64(F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= least)

    def run_entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in common.pieces(batch, "text", 1 << 18):
            data, at = _units(part.column(1), words)
            keys = part.column(0).to_numpy()
            if len(data) <= SLICE or len(keys) > 1:
                yield runs(data, at, keys, length)
                continue
            for b in range(0, len(data) - length + 1, SLICE):  # a run that is cut here is compared with others window by window
                own = data[b : b + SLICE + length - 1]
                e = runs(own, np.array([0, len(own)]), keys, length)
                e["s"] += b
                yield e

    first = _indexed(source, run_entries, "runs")
    asked = common.materialize(_by_document(first, (OPEN, WITNESS)), "asked")

    def window_entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in common.pieces(batch, "text", 1 << 18):
            data, at = _units(part.column(1), words)
            sums = common.prefix_sums(data)
            for key, b, packed in zip(part.column(0).to_pylist(), at, part.column(2).to_pylist()):
                p = _unpack(packed)
                n = p["n"].astype(np.int64)
                s = np.repeat(p["s"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                e = np.zeros(len(s), ENTRY)
                e["m"], e["key"], e["s"], e["n"] = common.span_hashes(sums, b + s, b + s + length), key, s, 1
                e["flag"] = np.where(np.repeat(p["kind"], n) == WITNESS, KNOWN | REPEATED, 0)
                yield e

    second = _indexed(_with_spans(source, asked, "inner").select("key", "text", "packed"), window_entries, "windows")
    found = _by_document(first.union(second), (FOUND,))
    copies = source.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    return common.materialize(found.join(copies, "key", "full"), "spans")


def covered(n_bytes: int, packed: bytes | None, copies: int | None, length: int) -> np.ndarray:
    """Which bytes of a text are in a repeated window."""
    if copies and n_bytes >= length:
        return np.ones(n_bytes, bool)
    d = np.zeros(n_bytes + 1, np.int32)
    if packed:
        p = _unpack(packed)
        np.add.at(d, p["s"], 1)
        np.add.at(d, p["s"].astype(np.int64) + p["n"] + length - 1, -1)
    return np.cumsum(d[:-1]) > 0


def word_bytes(gone: np.ndarray, begin: np.ndarray, end: np.ndarray, n_bytes: int) -> np.ndarray:
    """Which bytes go with the words that go: theirs, and what is between two of them."""
    d = np.zeros(n_bytes + 1, np.int32)
    last = np.append(~gone[1:], True)[: len(gone)] & gone
    first = np.append(True, ~gone[:-1])[: len(gone)] & gone
    d[begin[first]] += 1
    d[end[last]] -= 1
    return np.cumsum(d[:-1]) > 0


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400, payload: bool = False, words: bool = False, passage: int = 0) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also begins elsewhere, in this document or another.

    With words=True it removes each word that a string of `length` words covers which also begins elsewhere, whatever stands between the words.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. A passage above 0 adds n_passage_words: words that a string of so many words covers which also
    begins elsewhere (they are counted, not removed). payload=True adds row, a struct of docs' columns but the text, and kept, the rest of the text, where a
    character that a removal cut is dropped (the digest is of all bytes kept). A null text is empty. Rows that repeat are copies of each other, so all their text
    goes (if it is long enough). Columns are kept in row, so no name can clash. An empty table gives no rows.
    """
    common.tune(docs.sparkSession)
    spans = repeats(docs, text, length, words)
    if passage:
        said = repeats(docs, text, passage, True).select("key", F.col("packed").alias("said"), F.col("copies").alias("said_copies"))
        spans = common.materialize(spans.join(said, "key", "full"), "spans")
    more = ["said", "said_copies"] * bool(passage)
    source = docs.select(F.xxhash64(F.col(text).cast("string")).alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")] * payload)
    both = _with_spans(source, spans, "left", ("packed", *more[:1])).select("doc_id", "text", "packed", "copies", *["row"] * payload, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.text_buffer(batch.column(1))
            n, removed, runs_, sha, kept = np.diff(at), [], [], [], []
            begin, end, doc = common.words_of(data, at) if words else (None, None, np.zeros(0, np.int64))
            word_at = np.searchsorted(doc, np.arange(len(at)))
            for i, (b, e, packed, copies) in enumerate(zip(at[:-1], at[1:], batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = slice(word_at[i], word_at[i + 1])
                gone = covered(own.stop - own.start if words else int(e - b), packed, copies, length) if packed or copies else None
                if words and gone is not None:
                    gone = word_bytes(gone, begin[own] - b, end[own] - b, int(e - b))
                left = (data[b:e] if gone is None else data[b:e][~gone]).tobytes()
                removed.append(0 if gone is None else int(gone.sum()))
                runs_.append(0 if gone is None or not len(gone) else int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                sha.append(hashlib.sha256(left).hexdigest())
                if payload:
                    kept.append(whole_characters(data[b:e], gone))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string())]
            if passage:
                of = [(data[b:e], *x) for b, e, *x in zip(at[:-1], at[1:], batch.column("said").to_pylist(), batch.column("said_copies").to_pylist())]
                out.append(pa.array([int(covered(len(common.words_of(t, np.array([0, len(t)]))[0]), x, copies, passage).sum()) if x or copies else 0 for t, x, copies in of], pa.int64()))
            yield pa.RecordBatch.from_arrays([*out, *([batch.column(4), pa.array(kept, pa.string())] if payload else [])], schema.names)

    figures = [F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = both.select("doc_id", *figures, F.lit("").alias("kept_sha256"), *[F.lit(0).cast("long").alias("n_passage_words")] * bool(passage), *(["row", F.lit("").alias("kept")] if payload else [])).schema
    return both.mapInArrow(common.released(run), schema)


def whole_characters(text: np.ndarray, gone: np.ndarray | None) -> str:
    """What is left of a text without characters of which only some bytes are."""
    if gone is not None and len(text):
        char = np.cumsum((text & 0xC0) != 0x80) - 1
        cut = np.bincount(char, gone) > 0
        text = text[~cut[char]]
    return text.tobytes().decode()


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return deduplicate(docs, passage=PASSAGE_WORDS).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
