"""Telephony audio as a media column: mu-law, A-law and IMA-ADPCM in WAV containers, decoded to resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, texts

#: Payload bytes of a frame; padding byte.
FRAME, PAD = 576, b"\xff"
RATE, TARGET_RATE = 8000, 16000
#: Fixed values of the WAV format: codec tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Fixed values of IMA ADPCM: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
#: Bytes of media that are decoded together at most, unless one clip is larger.
BATCH_BYTES = 1 << 20


def mulaw_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes: an inverted sign, three exponent and four mantissa bits, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes: even bits inverted, the first two segments linear."""
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(segment == 0, low, (low + 256) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def half_band(taps: int = 8) -> np.ndarray:
    """Weights that interpolate half-way between samples: a Hann-windowed sinc of unit gain."""
    at = np.arange(taps) - (taps - 1) / 2
    w = np.sinc(at) * (0.5 + 0.5 * np.cos(np.pi * at / (taps / 2 + 0.5)))
    return w / w.sum()


HALF = half_band()


def wav(codec: str, payload: bytes) -> bytes:
    """A WAV file that holds a payload of whole frames as the codec's samples: a byte a sample, or for
    ADPCM a byte for two, in blocks of one frame that each begin with a zero state."""
    tag, n = TAGS[codec], len(payload)
    if codec == "adpcm":
        frames = np.frombuffer(payload, dtype=np.uint8).reshape(-1, FRAME)
        data = np.zeros((len(frames), FRAME + 4), dtype=np.uint8)
        data[:, 4:] = frames
        payload, align, samples = data.tobytes(), FRAME + 4, (2 * FRAME + 1) * len(frames)
        form = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * align // (2 * FRAME + 1), align, 4, 2, 2 * FRAME + 1)
    else:
        form, samples = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), n
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(raw: bytes) -> tuple[str, bytes]:
    """(codec, payload) of such a file; ValueError if a length or the format is wrong."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or struct.unpack_from("<I", raw, 4)[0] != len(raw) - 8:
        raise ValueError("no whole WAV file")
    at, parts = 12, {}
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at + 4)[0]
        parts[raw[at : at + 4]] = raw[at + 8 : at + 8 + size]
        if len(parts[raw[at : at + 4]]) != size:
            raise ValueError("a chunk that is cut off")
        at += 8 + size + (size & 1)
    codec = {v: k for k, v in TAGS.items()}.get(struct.unpack_from("<H", parts[b"fmt "])[0])
    if codec is None:
        raise ValueError("no telephony codec")
    data = parts[b"data"]
    if codec == "adpcm":
        data = np.frombuffer(data, dtype=np.uint8).reshape(-1, FRAME + 4)[:, 4:].tobytes()
    return codec, data


def adpcm_decode(blocks: np.ndarray, predictor: np.ndarray | None = None, index: np.ndarray | None = None) -> np.ndarray:
    """PCM of IMA-ADPCM blocks (one a row, low nibble first): a loop over the nibbles of a block, each
    step over all blocks at once."""
    n = len(blocks)
    nibbles = np.empty((2 * blocks.shape[1], n), dtype=np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks & 15).T, (blocks >> 4).T
    out = np.empty((len(nibbles) + 1, n), dtype=np.int16)
    now = np.zeros(n, dtype=np.int32) if predictor is None else predictor.astype(np.int32)
    at = np.zeros(n, dtype=np.int32) if index is None else np.clip(index.astype(np.int32), 0, 88)
    out[0] = now
    for i, code in enumerate(nibbles):
        step = STEPS[at]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        now = np.clip(now + np.where(code & 8, -change, change), -32768, 32767)
        at = np.clip(at + INDEX_CHANGES[code], 0, 88)
        out[i + 1] = now
    return out.T


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples themselves and windowed-sinc values half-way between."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    edge = len(HALF) // 2
    padded = np.pad(pcm.astype(np.float32), (edge - 1, edge), mode="edge")
    between = np.convolve(padded, HALF[::-1].astype(np.float32), mode="valid")
    out[1::2] = np.clip(np.rint(between), -32768, 32767).astype(np.int16)[: len(pcm)]
    return out


def decode_clips(clips: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM at TARGET_RATE of (codec, payload) clips; the ADPCM blocks of all clips are decoded together."""
    blocks = [np.frombuffer(p, dtype=np.uint8).reshape(-1, FRAME) for c, p in clips if c == "adpcm"]
    decoded = adpcm_decode(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for codec, payload in clips:
        if codec == "adpcm":
            n = len(payload) // FRAME
            pcm = decoded[at : at + n].reshape(-1)
            at += n
        else:
            pcm = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, dtype=np.uint8)]
        out.append(double_rate(pcm))
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """codec, samples, peak, root mean square, sign changes and checksum of the resampled PCM."""
    wide = pcm.astype(np.int32)
    loud = int(np.sqrt(np.mean(wide.astype(np.float64) ** 2))) if len(pcm) else 0
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{loud}:{crossings}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def choose_codec(payload: bytes) -> str:
    """By content alone, so equal payloads are stored alike."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's UTF-8 bytes, padded to whole frames, in a WAV file.
    A null text is empty and becomes one frame of padding; rows are kept as they repeat."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                payload = raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))
                rows.append((doc.as_py(), len(raw), wav(codec or choose_codec(payload), payload)))
                held += len(payload)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "media"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "media"])

    return map_arrow(texts(docs, id_col, text_col), task, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, keep_pcm: bool = True) -> DataFrame:
    """Decodes (doc_id, n_bytes, media): codec, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, with keep_pcm, pcm: 16-bit little-endian mono at TARGET_RATE.  A null
    media gives nulls; a damaged one fails the job."""
    names = ["doc_id", "n_bytes", "codec", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decoded(rows: list[tuple]) -> pa.RecordBatch:
            clips = [parse_wav(m) if m is not None else ("", b"") for _, _, m in rows]
            pcm = iter(decode_clips([c for c in clips if c[0]]))
            out = []
            for (doc, n, m), (codec, payload) in zip(rows, clips):
                if m is None:
                    out.append((doc, n, *[None] * 8))
                    continue
                x = next(pcm)
                out.append((doc, n, codec, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, x), x.astype("<i2").tobytes() if keep_pcm else None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, n, raw in zip(batch.column(0), batch.column(1), batch.column(2)):
                rows.append((doc.as_py(), n.as_py(), raw.as_py()))
                held += len(rows[-1][2] or b"")
                if held > BATCH_BYTES:
                    yield decoded(rows)
                    rows, held = [], 0
            if rows:
                yield decoded(rows)

    schema = "doc_id long, n_bytes long, codec string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    found = map_arrow(media.select("doc_id", "n_bytes", "media"), task, schema)
    return found if keep_pcm else found.drop("pcm")


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_pcm: bool = False) -> DataFrame:
    """Stores every text as audio in a binary column of a written table and decodes what is read back."""
    stored = cut(encode_media(docs, id_col, text_col), "media", compression="zstd")
    return decode_media(stored, keep_pcm)
