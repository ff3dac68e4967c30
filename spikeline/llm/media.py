"""Media columns: PNG files in binary columns, decoded and hashed inside tasks.

PNG is read and written here from its parts: the signature, length-tagged chunks
with a CRC-32 each, zlib streams in IDAT, and row filters undone with numpy.
The perceptual hash keeps the signs of low-frequency cosine coefficients.

Nulls: a null text is an empty payload; a null or broken file decodes to null
samples with the reason in `error`. Each row stands alone: repeated rows give
repeated results, tables without rows none, other columns are passed on or left out
untouched.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # of the color types read here: gray, RGB, gray + alpha, RGBA
WIDTH = 64  # samples in a row, where bytes are stored as an image
IDAT_BYTES = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """Gray 8-bit rows as a PNG file; of the filters none, sub and up the one that leaves the smallest values."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    kinds = (samples, sub, up)
    best = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum() for x in kinds]))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = kinds[best]
    packed = zlib.compress(rows.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """rows: the filter type, then the filtered bytes. Runs of rows with one filter go together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    height, stride = out.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), height]):
        kind = kinds[a]
        if kind == 1:
            pixels = out[a:b].reshape(b - a, stride // bpp, bpp)
            out[a:b] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(b - a, stride)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(np.int16) if y else np.zeros(stride, np.int16)
                line = out[y].astype(np.int16)
                for x in range(0, stride, bpp):
                    left = line[x - bpp : x] if x else np.zeros(bpp, np.int16)
                    here = above[x : x + bpp]
                    if kind == 3:
                        guess = (left + here) >> 1
                    else:
                        corner = above[x - bpp : x] if x else np.zeros(bpp, np.int16)
                        d = [np.abs(here - corner), np.abs(left - corner), np.abs(left + here - 2 * corner)]
                        guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], here, corner))
                    line[x : x + bpp] = (line[x : x + bpp] + guess) & 255
                out[y] = line.astype(np.uint8)
        elif kind:
            raise ValueError(f"filter {kind} is unknown")
    return out


def decode_png(file: bytes) -> np.ndarray:
    """Samples as (height, width, channels); ValueError if anything in the file is wrong or not 8-bit."""
    if file[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(file) and not ended:
        (size,) = struct.unpack_from(">I", file, at)
        kind, body = file[at + 4 : at + 8], file[at + 8 : at + 8 + size]
        if at + 12 + size > len(file):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(file[at + 4 : at + 8 + size]) != struct.unpack_from(">I", file, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not head or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or color not in CHANNELS or interlaced:
        raise ValueError("only 8-bit samples without palette or interlacing are read")
    bpp = CHANNELS[color]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if raw.size != height * (width * bpp + 1):
        raise ValueError("the number of samples differs from the header's")
    return _unfilter(raw.reshape(height, width * bpp + 1), bpp).reshape(height, width, bpp)


def _resized(x: np.ndarray, n: int) -> np.ndarray:
    """n rows: means of the rows that fall to each, or repeats where there are fewer."""
    starts = np.arange(n) * x.shape[0] // n
    if x.shape[0] < n:
        return x[starts]
    return np.add.reduceat(x, starts, axis=0) / np.diff(np.append(starts, x.shape[0]))[:, None]


COSINES = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None] + 1) / 64)


def cosine_hash(gray: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients of the picture,
    brought to 32 x 32, lie above their median."""
    small = _resized(_resized(gray.astype(np.float64), 32).T, 32)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def bytes_as_samples(data: bytes) -> np.ndarray:
    """Rows of 64 samples, filled up with zeros, one row at least."""
    height = max(1, -(-len(data) // WIDTH))
    return np.frombuffer(data.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)


def encode_bytes(df: DataFrame, column: str, out: str = "png") -> DataFrame:
    """Adds `out`: the bytes of a binary column as a gray PNG file (null: of no bytes)."""

    @F.pandas_udf("binary")
    def png(data):
        return data.map(lambda x: encode_png(bytes_as_samples(bytes(x or b""))))

    return df.withColumn(out, png(column))


MEDIA = "width int, height int, channels int, samples binary, cosine_hash string, error string"


def decode_media(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """Adds a struct: width, height, channels, samples (binary), cosine_hash, error."""

    @F.pandas_udf(MEDIA)
    def decoded(files):
        import pandas as pd

        rows = []
        for file in files:
            try:
                if file is None:
                    raise ValueError("null")
                x = decode_png(bytes(file))
                rows.append((x.shape[1], x.shape[0], x.shape[2], x.tobytes(), cosine_hash(x.mean(axis=2) if x.shape[2] > 1 else x[:, :, 0]), None))
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "channels", "samples", "cosine_hash", "error"]).astype({x: "Int32" for x in ("width", "height", "channels")})

    return df.withColumn(out, decoded(column))


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, every text's PNG file in a binary column of a written table. docs: doc_id, text."""
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    files = encode_bytes(data, "data", "media").select("doc_id", F.length("data").cast("long").alias("n_bytes"), "media")
    return materialize(files, "media")


def media_digests(files: DataFrame) -> DataFrame:
    """What is told of the payload of stored_media(), read back from its files."""
    told = decode_media(files, "media", "read").withColumn("payload", F.col("read.samples"))
    tail = F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")
    return told.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("read.cosine_hash").alias("feature"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a PNG, read back and hashed. No shuffle; a task holds one batch of rows at a time."""
    return media_digests(stored_media(read(spark, sf_dir, "documents")))


QUERIES = {"op6_media": op6_media}
ORACLE: dict[str, str] = {}
