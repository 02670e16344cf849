"""Telephony audio as media columns.

A payload is stored losslessly as the 8-bit samples of a mu-law WAV file and
read back from it. mu-law and A-law codes are expanded by tables of 256 entries
made from the G.711 rule; IMA ADPCM blocks are decoded sample by sample with
numpy across all blocks of a batch. The expanded mu-law signal is resampled and
stored as 16-bit PCM in a second WAV file.

Scale: one narrow pass; memory is bounded by a group of rows of about GROUP
bytes (or one longer row).

Defined results: a null text is an empty payload; payloads are padded with zero
bytes to a positive multiple of BLOCK. Equal texts have equal values. Only the
columns in `keep` are passed on; repeated rows stay.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.store import passed, short_batches
from pageloom.llm.words import row_groups, utf8

BLOCK, RATE, PCM_RATE, GROUP = 64, 8000, 16000, 1 << 18
PCM, ALAW, MULAW = 1, 6, 7


@cache
def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 8-bit code to linear sample."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """G.711 A-law: 8-bit code to linear sample."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


@cache
def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For index * 16 + nibble: the change of the sample, and the next index * 16."""
    index, nibble = np.repeat(np.arange(89), 16), np.tile(np.arange(16), 89)
    step = STEPS[index]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32), (np.clip(index + INDEX_CHANGE[nibble & 7], 0, 88) * 16).astype(np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: (n, block bytes) uint8 to (n, 1 + 2 * (block bytes - 4)) int16; a step runs over all blocks."""
    change, following = _adpcm_tables()
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = sample
    coded = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(len(out) - 1):
        nibble = (coded[i >> 1] >> 4) if i & 1 else (coded[i >> 1] & 15)
        at = index + nibble
        sample += change[at]
        np.clip(sample, -32768, 32767, out=sample)
        index = following[at]
        out[i + 1] = sample
    return out.T


def resample(x: np.ndarray, first: np.ndarray, source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear interpolation in integers of the signals between the offsets; each keeps to its own samples. Returns samples and offsets."""
    sizes = np.diff(first)
    out_sizes = sizes * target // source
    out_first = np.concatenate([[0], np.cumsum(out_sizes)])
    place = (np.arange(out_first[-1]) - np.repeat(out_first[:-1], out_sizes)) * source
    at = place // target
    part = (place - at * target).astype(np.int32)
    last = np.repeat(first[1:] - 1, out_sizes)
    at += np.repeat(first[:-1], out_sizes)
    a, b = x[at].astype(np.int32), x[np.minimum(at + 1, last)].astype(np.int32)
    return (a + (b - a) * part // target).astype(np.int16), out_first


def wav(samples: bytes, kind: int, rate: int) -> bytes:
    """A mono WAV file; kind PCM has 16 bits, the others 8."""
    width = 2 if kind == PCM else 1
    fmt = struct.pack("<HHIIHHH", kind, 1, rate, rate * width, width, 8 * width, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(samples) // width) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, bytes]:
    """Kind, rate and the bytes of the samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", data, at + 8)
        elif name == b"data":
            if kind is None or at + 8 + size > len(data):
                break
            return kind, rate, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without whole format and samples")


def padded(n: int) -> int:
    return max(BLOCK, -(-n // BLOCK) * BLOCK)


def _features(codes: np.ndarray, first: np.ndarray) -> list[str]:
    mu, a = mulaw_table()[codes].astype(np.int64), alaw_table()[codes].astype(np.int64)
    blocks = adpcm_decode(codes.reshape(-1, BLOCK)).astype(np.int64)
    block_first = first[:-1] // BLOCK
    sign = np.zeros(len(mu), dtype=np.int64)
    sign[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    sign[first[:-1]] = 0
    n = np.diff(first)
    columns = [n, np.add.reduceat(mu * mu, first[:-1]) // n, np.add.reduceat(sign, first[:-1]), np.add.reduceat(a * a, first[:-1]) // n, np.add.reduceat((blocks * blocks).sum(1), block_first) // (n // BLOCK * blocks.shape[1]), np.maximum.reduceat(np.abs(blocks).max(1), block_first)]
    return [f"n={i};mulaw={m};crossings={z};alaw={b};adpcm={d};peak={p}" for i, m, z, b, d, p in zip(*(c.tolist() for c in columns), strict=True)]


def _store(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        for a, b in row_groups(offsets, GROUP):
            sizes = np.diff(offsets[a : b + 1])
            media = [wav((x := data[s : s + n].tobytes()) + bytes(padded(n) - n), MULAW, RATE) for s, n in zip(offsets[a:b].tolist(), sizes.tolist(), strict=True)]
            payload = [read_wav(x)[2] for x in media]
            first = np.concatenate([[0], np.cumsum([len(x) for x in payload])])
            codes = np.frombuffer(b"".join(payload), np.uint8)
            pcm, pcm_first = resample(mulaw_table()[codes], first, RATE, PCM_RATE)
            raw = pcm.astype("<i2").tobytes()
            pcm_files = [wav(raw[2 * s : 2 * e], PCM, PCM_RATE) for s, e in zip(pcm_first[:-1].tolist(), pcm_first[1:].tolist(), strict=True)]
            kept = [batch.column(x).slice(a, b - a).cast(fields.field(x).type) for x in batch.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(pcm_files, pa.binary()), pa.array(_features(codes, first), pa.string())], schema=fields)


def store_media(documents: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the columns in keep, n_bytes, media (mu-law WAV), payload (read back from it), pcm (resampled WAV) and feature, which win over columns in keep with their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(documents.sparkSession)
    keep = passed(keep, ("n_bytes", "media", "payload", "pcm", "feature"))
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(source.schema[x] for x in keep), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("pcm", T.BinaryType()), T.StructField("feature", T.StringType())])
    fields = to_arrow_schema(schema)
    return source.mapInArrow(lambda it: _store(it, fields), schema)


def op3_telephony(spark, sf_dir: str) -> DataFrame:
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
