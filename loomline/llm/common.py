"""Shared pieces of the llm operators: tables in the shared folder, and words and fingerprints of text batches in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these (space, and tab to carriage return); all are ASCII, so bytes of UTF-8 can be looked at one by one.
SPACES = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that numpy code works on at once; a longer document is a piece by itself.
PIECE_BYTES = 2 << 20
#: Arrow batches after which a worker gives back what is free.
RELEASE_BATCHES = 8

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def tune(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that a worker's memory doesn't depend on the lengths of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def release() -> None:
    """Gives memory that is free in this process back to the system (glibc only)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, during and after which the worker gives memory that it has freed back to the system: workers stay from task to task and from one operator to the next."""

    def now_and_then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches, 1):
            yield batch
            if k % RELEASE_BATCHES == 0:
                release()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(now_and_then(batches))
        finally:
            release()

    return through


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def few(spark: SparkSession) -> int:
    """Files for a table of narrow rows: two for each core, however many tasks made the rows."""
    return 2 * spark.sparkContext.defaultParallelism


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs nothing. It goes when the session ends.

    narrow: rows without texts, which are dealt anew so that there are few files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(few(spark))
    path = f"{shared_folder(spark)}/loomline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(remainder_of: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo remainder_of; null for a null doc_id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "UTF-8")) % remainder_of


def n_words(text: str | Column) -> Column:
    """Words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings end to end, and where each begins (one more entry than strings); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most so many bytes of text each, or one row."""
    _, at = text_buffer(batch.column(batch.schema.get_field_index(text)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, min(end, n) - begin)
        begin = min(end, n)


def words_of(data: np.ndarray, at: np.ndarray, parts: np.ndarray = ~_IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in data (a run of the bytes that parts marks), and the document it is in. A word never crosses from one document into the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _FOLD[data]


def _table(kind: str, base: int, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:  # a worker's first texts may be empty
        x = np.full(max(n, 1 << 16), np.uint64(base))
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, from which span_hashes() has the fingerprint of any span in constant time."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans; equal bytes have equal fingerprints wherever they stand."""
    raw = (sums[end] - sums[begin]) * _table("down", _BASE_INVERSE, len(sums))[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words (case-folded, or as they are) of all texts in order, and where each text's begin (one more entry than texts)."""
    data, at = text_buffer(texts)
    data = fold_case(data) if fold else data
    begin, end, doc = words_of(data, at)
    return span_hashes(prefix_sums(data), begin, end), np.searchsorted(doc, np.arange(len(at)))


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in arrays], pa.binary())
