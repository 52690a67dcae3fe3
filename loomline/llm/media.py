"""Media columns: telephony audio kept in a binary column.

Stored form: a WAV file with mu-law (tag 7), A-law (tag 6) or IMA ADPCM (tag 17) samples at 8 kHz, one channel. decode() expands mu-law and A-law by lookup
tables, decodes ADPCM step by step over the blocks of all files of a batch at once, and resamples to 16-bit PCM at 16 kHz.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CODECS = ("mulaw", "alaw", "adpcm")
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
RATE, OUT_RATE = 8000, 16000
UNIT = 64  # bytes that payloads are padded to; an ADPCM block holds so many after its header of 4
PIECE = 1 << 20

# The quantizer steps and the index changes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371,
    408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code (G.711): the code is complemented; sign, three bits of exponent, four of mantissa."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code (G.711): even bits are inverted; a set sign bit means positive."""
    code = np.arange(256) ^ 0x55
    exponent, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, low + 8, low + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
_STEP, _NIBBLE = np.array(STEPS)[:, None], np.arange(16)[None, :]
_SIZE = (_STEP >> 3) + np.where(_NIBBLE & 4, _STEP, 0) + np.where(_NIBBLE & 2, _STEP >> 1, 0) + np.where(_NIBBLE & 1, _STEP >> 2, 0)
ADPCM_CHANGE = np.where(_NIBBLE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
ADPCM_NEXT = (np.clip(np.arange(89)[:, None] + np.array(CHANGES)[_NIBBLE & 7], 0, 88) * 16).astype(np.int32).ravel()


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file whose samples are payload, a multiple of 64 bytes. ADPCM blocks begin with predictor 0 and step index 0, and have payload as their nibbles."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, 4 + UNIT), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        payload, align, bits, extra = blocks.tobytes(), 4 + UNIT, 4, struct.pack("<HH", 2, 2 * UNIT + 1)
    else:
        align, bits, extra = 1, 8, struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE if codec != "adpcm" else RATE * align // (2 * UNIT + 1), align, bits) + extra
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + len(payload)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def parse_wav(media: bytes) -> tuple[str, memoryview]:
    """Codec and sample bytes of a stored file; ValueError if it is not one of ours."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((c for c, t in TAGS.items() if t == tag), None)
            if codec is None or channels != 1 or rate != RATE:
                raise ValueError(f"tag {tag}, {channels} channels, {rate} Hz can't be decoded")
        elif kind == b"data":
            if codec is None or at + 8 + size > len(media) or codec == "adpcm" and size % (4 + UNIT):
                raise ValueError("the file is cut short")
            return codec, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(codec: str, samples: memoryview) -> bytes:
    return bytes(samples) if codec != "adpcm" else np.frombuffer(samples, np.uint8).reshape(-1, 4 + UNIT)[:, 4:].tobytes()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """PCM of blocks of 4 + 64 bytes, all blocks at once: one numpy step per sample of a block. A block gives its header's sample and 128 more."""
    blocks = data.reshape(-1, 4 + UNIT)
    value = blocks[:, :2].copy().view(np.int16)[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out = np.empty((2 * UNIT + 1, len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * UNIT):
        at = index + (codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15)
        value += ADPCM_CHANGE[at]
        np.clip(value, -32768, 32767, out=value)
        index = ADPCM_NEXT[at]
        out[k + 1] = value
    return np.ascontiguousarray(out.T).ravel()


def resample(pcm: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation, file by file (at: where each begins, one more entry than files); the last sample of a file is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    following = np.empty_like(pcm)
    following[:-1] = pcm[1:]
    following[at[1:] - 1] = pcm[at[1:] - 1]
    out[1::2] = (pcm.astype(np.int32) + following) >> 1
    return out


def decode(files: list[bytes]) -> list[tuple[str, bytes, np.ndarray]]:
    """Codec, sample bytes as stored, and 16 kHz PCM of each file."""
    parsed = [parse_wav(m) for m in files]
    out: list = [None] * len(files)
    for codec in CODECS:
        own = [i for i, (c, samples) in enumerate(parsed) if c == codec and len(samples)]
        if not own:
            continue
        data = np.concatenate([np.frombuffer(parsed[i][1], np.uint8) for i in own])
        pcm = MULAW[data] if codec == "mulaw" else ALAW[data] if codec == "alaw" else decode_adpcm(data)
        ratio = (2 * UNIT + 1, 4 + UNIT) if codec == "adpcm" else (1, 1)
        at = np.cumsum([0, *[len(parsed[i][1]) * ratio[0] // ratio[1] for i in own]])
        both = resample(pcm, at)
        for k, i in enumerate(own):
            out[i] = (codec, payload_of(*parsed[i]), both[2 * at[k] : 2 * at[k + 1]])
    return [x or (parsed[i][0], b"", np.zeros(0, np.int16)) for i, x in enumerate(out)]


def features(codec: str, pcm: np.ndarray) -> str:
    """codec:samples:peak:zero crossings:energy, of integers only, so that equal files have equal features on any machine."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{crossings}:{int(np.dot(wide, wide))}"


_COLUMNS = {
    "n_bytes": (T.LongType(), pa.int64()), "payload_bytes": (T.LongType(), pa.int64()), "payload_sha256": (T.StringType(), pa.string()), "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()), "media_sha256": (T.StringType(), pa.string()), "feature": (T.StringType(), pa.string()), "codec": (T.StringType(), pa.string()),
    "media": (T.BinaryType(), pa.binary()), "pcm": (T.BinaryType(), pa.binary()),
}


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("media", "pcm"), codec: str | None = None) -> DataFrame:
    """Stores each text as a telephony file and reads it back. Returns doc_id, the figures and digests, codec, and of the large columns those in keep.

    The payload is the UTF-8 bytes (none for null) with bytes 0 up to a positive multiple of 64; codec None picks one by the payload's CRC-32, so equal texts
    have equal values. The payload's digests are of what parse_wav() finds in the stored file. Other columns of docs play no part; rows that repeat stay.
    """
    common.tune(docs.sparkSession)
    names = [n for n in _COLUMNS if n not in ("media", "pcm") or n in keep]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, "text", PIECE):
                data, at = common.text_buffer(part.column(1))
                raw, files = data.tobytes(), []
                for b, e in zip(at[:-1], at[1:]):
                    payload = raw[b:e] + bytes((b - e) % UNIT or (0 if e > b else UNIT))
                    files.append(wav(codec or CODECS[zlib.crc32(payload) % 3], payload))
                rows: dict[str, list] = {n: [] for n in names}
                for media, (kind, payload, pcm), n in zip(files, decode(files), np.diff(at)):
                    row = {
                        "n_bytes": int(n), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(kind, pcm), "codec": kind, "media": media,
                    }
                    if "pcm" in names:
                        row["pcm"] = pcm.tobytes()
                    for name in names:
                        rows[name].append(row[name])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(rows[n], _COLUMNS[n][1]) for n in names]], ["doc_id", *names])

    return source.mapInArrow(common.released(run), T.StructType([source.schema["doc_id"], *[T.StructField(n, _COLUMNS[n][0]) for n in names]]))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(common.documents(spark, sf_dir), keep=())
