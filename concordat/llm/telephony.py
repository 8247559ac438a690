"""Telephony audio in media columns: G.711 mu-law and A-law, IMA ADPCM blocks, 8 kHz mono WAV files, resampled PCM."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.stage import materialise, small_batches
from concordat.llm.text import buffers

RATE = 8000
#: Payloads are filled to whole units of so many bytes; an ADPCM block is a twelfth of it.
UNIT = 576
BLOCK = 48
#: WAVE format codes.
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 17


def mu_law_table() -> np.ndarray:
    """The 16-bit value of each mu-law code (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 16-bit value of each A-law code (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, value = code >> 4 & 7, (code & 0x0F) << 4
    value = np.where(segment == 0, value + 8, value + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


MU, A = mu_law_table(), a_law_table()

#: Fixed values of IMA ADPCM: step sizes and the change of the step index by a code's magnitude.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
INDEX_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + code: the difference, and 16 times the next step index."""
    code, step = np.arange(16), STEPS[:, None]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGE)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


CHANGE, AFTER = _adpcm_tables()


def adpcm_decode(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, a row each: the header's sample and two for each further byte.

    Steps run along a block and each handles all blocks at once. A step index beyond the table counts as its last.
    """
    blocks = data.reshape(-1, block)
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    body = np.ascontiguousarray(blocks[:, 4:].T)
    codes = np.empty((2 * body.shape[0], body.shape[1]), dtype=np.int32)
    codes[0::2] = body & 15
    codes[1::2] = body >> 4
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = head
    for i, code in enumerate(codes):
        code += at
        head += CHANGE[code]
        np.clip(head, -32768, 32767, out=head)
        at = AFTER[code]
        out[i + 1] = head
    return out.T


def adpcm_encode(samples: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Bytes of mono IMA ADPCM blocks of 16-bit samples, filled with silence to whole blocks."""
    per = 2 * (block - 4) + 1
    count = max(1, -(-len(samples) // per))
    rows = np.zeros((count, per), np.int32)
    rows.ravel()[: len(samples)] = samples
    head, at = rows[:, 0].copy(), np.zeros(count, np.int32)
    out = np.zeros((count, block), np.uint8)
    out[:, :2] = head.astype("<i2")[:, None].view(np.uint8).reshape(count, 2)
    for i in range(1, per):
        step, gap = STEPS[at // 16], rows[:, i] - head
        code = np.where(gap < 0, 8, 0)
        gap = np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            more = gap >= part
            code |= np.where(more, bit, 0)
            gap = np.where(more, gap - part, gap)
        head = np.clip(head + CHANGE[at + code], -32768, 32767)
        at = AFTER[at + code]
        out[:, 4 + (i - 1) // 2] |= (code << 4 * ((i - 1) % 2)).astype(np.uint8)
    return out.ravel()


def wav(payload: bytes, kind: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file whose data chunk is payload, byte for byte."""
    bits = 4 if kind == IMA_ADPCM else 8
    per = 2 * (block - 4) + 1 if kind == IMA_ADPCM else 1
    extra = struct.pack("<HH", 2, per) if kind == IMA_ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * block // per, block, bits) + extra
    fact = struct.pack("<4sII", b"fact", 4, len(payload) // block * per)
    size = 4 + 8 + len(form) + len(fact) + 8 + len(payload) + len(payload) % 2
    return struct.pack("<4sI4s4sI", b"RIFF", size, b"WAVE", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format code, block size, data chunk) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, block = 12, 0, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            return kind, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def samples(kind: int, block: int, data: bytes) -> np.ndarray:
    """16-bit PCM of a telephony WAV's data chunk."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if kind == IMA_ADPCM:
        return adpcm_decode(raw, block).ravel()
    return (MU if kind == MU_LAW else A)[raw]


def _half_band() -> np.ndarray:
    """The odd taps of a windowed-sinc low-pass that doubles the rate, in units of 2**-15, with sum 2**15."""
    k = np.arange(-4, 4) + 0.5
    taps = np.sinc(k) * (0.54 + 0.46 * np.cos(np.pi * k / 4.5))
    taps = np.round(taps / taps.sum() * 32768).astype(np.int32)
    taps[3] += 32768 - taps.sum()
    return taps


TAPS = _half_band()


def resample_double(pcm: np.ndarray, off: np.ndarray | None = None) -> np.ndarray:
    """16-bit PCM at twice the rate: each sample, then the filtered value half-way to the next; edges see silence.

    With off, the n + 1 offsets of n signals in pcm, all are filtered at once and none hears another.
    """
    off = np.array([0, len(pcm)]) if off is None else off
    half = len(TAPS) // 2
    at = np.arange(len(pcm)) + 2 * half * np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = np.zeros(len(pcm) + 2 * half * (len(off) - 1) + 1, np.int32)
    wide[half + at] = pcm
    n = len(wide) - 2 * half
    between = np.full(max(n, 0), 1 << 14, np.int32)
    for j, tap in enumerate(TAPS.tolist()):
        between += wide[j + 1 : j + 1 + n] * tap
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between[at] >> 15, -32768, 32767)
    return out


def payload(text: bytes, unit: int = UNIT) -> bytes:
    """text filled with bytes 255 to a positive multiple of unit."""
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled, as the samples of a mu-law WAV file.

    A null or empty text is one unit of bytes 255. Rows are handled one by one; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            data, off = raw.tobytes(), off.tolist()
            for first in range(0, batch.num_rows, 64):
                bounds = off[first : first + 65]
                media = [wav(payload(data[a:b])) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, 64), pa.array(np.diff(bounds)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def describe(pcm: np.ndarray, off: np.ndarray | None = None) -> list[str]:
    """For each signal its level, peak and crossings of zero, in integers, and the CRC-32 of its samples. off: the
    n + 1 offsets of n signals that are not empty."""
    off = np.array([0, len(pcm)]) if off is None else off
    start, n = off[:-1], np.diff(off)
    wide = pcm.astype(np.int64)
    squares, peak = np.add.reduceat(wide * wide, start), np.maximum.reduceat(np.abs(wide), start)
    turns = np.zeros(len(pcm), np.int64)
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[start] = 0
    turns = np.add.reduceat(turns, start)
    data = memoryview(np.ascontiguousarray(pcm.astype("<i2"))).cast("B")
    rows = zip(squares.tolist(), n.tolist(), peak.tolist(), turns.tolist(), start.tolist())
    return [f"{math.isqrt(s // k)}:{p}:{t}:{zlib.crc32(data[2 * a : 2 * (a + k)]):08x}" for s, k, p, t, a in rows]


def decode_media(media: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Read media files back: doc_id, n_bytes, payload figures, features and, with keep_pcm, the 16 kHz PCM.

    The feature describes the samples as the file's codec expands them, the same bytes read as A-law and as ADPCM
    blocks, and the PCM at twice the rate. The files of a batch are expanded together: codes by look-up tables, ADPCM
    step by step along the blocks of all files.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                stored = [x.as_buffer().to_pybytes() for x in part.column(2)]
                files = [read_wav(x) for x in stored]
                data = [x for _, _, x in files]
                raw = np.frombuffer(b"".join(data), np.uint8)
                off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
                blocks = adpcm_decode(raw)
                if {kind for kind, _, _ in files} == {MU_LAW}:
                    pcm, cuts = MU[raw], off
                else:
                    own = [samples(*x) for x in files]
                    pcm, cuts = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
                wide = resample_double(pcm, cuts)
                feature = ["|".join(x) for x in zip(describe(pcm, cuts), describe(A[raw], off), describe(blocks.ravel(), off // BLOCK * blocks.shape[1]), describe(wide, 2 * cuts))]
                kept = [wide[2 * a : 2 * b].astype("<i2").tobytes() if keep_pcm else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = (
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                    pa.array([zlib.crc32(x[-32:]) for x in data], pa.int64()),
                    pa.array([len(x) for x in stored], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                    pa.array(feature),
                    pa.array(kept, pa.binary()),
                )
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm16k"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm16k binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, fields)


def write_pcm(media: DataFrame, path: str) -> None:
    """Decode media files and store their resampled PCM, with the figures, as a Parquet table."""
    decode_media(media).write.option("compression", "zstd").parquet(path)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text of docs as a media file in the shared folder, read the files back and describe them."""
    return decode_media(materialise(store_text(docs), "media"), keep_pcm=False).drop("pcm16k")
