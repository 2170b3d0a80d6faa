"""Operator 9: telephony audio in media columns.

mu-law and A-law bytes expand by 256-entry tables built from the companding rule; IMA ADPCM blocks are decoded
by numpy across all blocks of a batch, sample by sample position. PCM is resampled by exact linear interpolation
in integers. A stored form is a WAV file: companded codes are one byte a sample; ADPCM data are 4-byte headers
and nibbles. All of it is lossless for the payload: the bytes read back are the bytes stored.

Null and empty texts have a payload of 64 zero bytes. Equal texts give equal values. No row is dropped or cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import common as C

RATE, STORED_RATE, BLOCK = 8000, 16000, 256
#: WAV format tags.
TAGS = {"mulaw": 7, "alaw": 6, "ima": 17}
CODECS = ("mulaw", "alaw", "ima")
#: The IMA index steps.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: The IMA step sizes.
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    step = (a >> 4 & 7).astype(np.int32)
    size = ((a & 15).astype(np.int32) << 4) + 8
    size = np.where(step > 0, (size + 256) << np.maximum(step - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA blocks, (n, bytes) uint8 -> (n, 1 + 2 * (bytes - 4)) int16, all blocks at once."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    for i, byte in enumerate(data):
        for half, code in enumerate((byte & 15, byte >> 4)):
            step = STEPS[index]
            delta = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
            index = np.clip(index + INDEX_STEP[code], 0, 88)
            out[1 + 2 * i + half] = value
    return out.T


def store(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A WAV file whose samples are the payload. ADPCM: BLOCK data bytes a block, the last may hold fewer."""
    if codec == "ima":
        samples = 1 + 2 * BLOCK
        data = b"".join(bytes(4) + payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK))
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * (BLOCK + 4) // samples, BLOCK + 4, 4, 2, samples)
        n = sum(1 + 2 * min(BLOCK, len(payload) - i) for i in range(0, len(payload), BLOCK))
    else:
        data, n = payload, len(payload)
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block size and sample data of a stored WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[kind] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag, _, rate, _, block = struct.unpack_from("<HHIIH", found[b"fmt "])
    return next(k for k, v in TAGS.items() if v == tag), rate, block, found[b"data"]


def payload_of(codec: str, block: int, data: bytes) -> bytes:
    """The stored bytes without block headers."""
    return data if codec != "ima" else b"".join(data[i + 4 : i + block] for i in range(0, len(data), block))


def pcm_of_many(parsed: list[tuple[str, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of many stored files; ADPCM blocks of equal size are decoded together."""
    out: list = [None] * len(parsed)
    groups: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, (codec, _, block, data) in enumerate(parsed):
        if codec != "ima":
            out[i] = TABLES[codec][np.frombuffer(data, np.uint8)]
        else:
            out[i] = {}
            for k, at in enumerate(range(0, len(data), block)):
                part = data[at : at + block]
                groups.setdefault(len(part), []).append((i, k, part))
    for size, members in groups.items():
        pcm = ima_decode(np.frombuffer(b"".join(m[2] for m in members), np.uint8).reshape(-1, size))
        for (i, k, _), row in zip(members, pcm):
            out[i][k] = row
    return [np.concatenate([x[k] for k in sorted(x)]) if isinstance(x, dict) else x for x in out]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers: sample n lies at n * rate / to; the last sample is held."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    n = len(pcm) * up // down
    out = np.empty(n, np.int16)
    x = np.append(pcm, pcm[-1:]).astype(np.int32)
    for phase in range(min(up, n)):
        at, part = divmod(phase * down, up)
        want = len(range(phase, n, up))
        low, high = x[at::down][:want], x[at + 1 :: down][:want]
        out[phase::up] = low if not part else low[: len(high)] + (high - low[: len(high)]) * part // up
    return out


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(pcm: np.ndarray, codec: str) -> str:
    x = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};n={len(pcm)};rms={np.sqrt(x @ x / max(1, len(x))):.3f};peak={int(np.abs(pcm.astype(np.int32)).max(initial=0))};zc={crossings};pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def codec_for(body: bytes) -> str:
    """Chosen by content, so that equal texts have equal stored forms."""
    return CODECS[zlib.crc32(body) % len(CODECS)]


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pcm: bool = True) -> DataFrame:
    """id_col, n_bytes (of the text), media (binary WAV), and with `pcm` pcm (binary, 16-bit little-endian at STORED_RATE): columns to be stored."""

    def run(batches):
        for b in batches:
            raw = C.raw_texts(b)
            media = [store(p, codec_for(p)) for p in map(payload, raw)]
            out = {"id": b.column(0), "n_bytes": list(map(len, raw)), "media": media}
            yield out | ({"pcm": pcm_of_media(media)} if pcm else {})

    kinds = "id long, n_bytes long, media binary" + (", pcm binary" if pcm else "")
    return C.arrow_map(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), run, kinds, batch_mb=16).withColumnRenamed("id", id_col)


def pcm_of_media(media: list[bytes]) -> list[bytes]:
    """Stored forms as PCM bytes at STORED_RATE, decoded together."""
    parsed = list(map(parse, media))
    return [resample(x, p[1], STORED_RATE).astype("<i2").tobytes() for p, x in zip(parsed, pcm_of_many(parsed))]


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the media query: media columns are written to the shared folder, read back, decoded and resampled."""
    scratch = C.Scratch(docs.sparkSession, "media")
    stored = scratch.write(encode_media(docs.select("doc_id", "text"), pcm=False), "media", plain=["media"])

    def run(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            parsed = list(map(parse, media))
            back = [payload_of(codec, block, data) for codec, _, block, data in parsed]
            yield {
                "doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "payload_bytes": list(map(len, back)), "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
                "tail_crc32": [zlib.crc32(p[-64:]) for p in back], "media_bytes": list(map(len, media)), "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "feature": [feature(np.frombuffer(x, "<i2"), p[0]) for p, x in zip(parsed, pcm_of_media(media))],
            }

    return C.arrow_map(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", batch_mb=16)
