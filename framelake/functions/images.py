"""Decoding of embedded images to pixel histograms, without image libraries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import sample_indices

#: Images of this size and more are thinned to about TARGET.
LARGE, TARGET = 300, 150
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG, not interlaced, as (height, width, 3); alpha multiplies."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts, palette, head = 8, [], None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or interlaced or (color not in _CHANNELS and color != 3):
        raise ValueError("unsupported PNG")
    k = 1 if color == 3 else _CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * k)
    rows = np.zeros((height, width * k), np.uint8)
    before = np.zeros(width * k, np.int32)
    for y in range(height):
        line, f = raw[y, 1:].astype(np.int32), raw[y, 0]
        if f == 2:
            line = (line + before) & 255
        elif f in (1, 3, 4):
            out = np.zeros_like(line)
            for x in range(len(line)):
                a = out[x - k] if x >= k else 0
                b, c = before[x], before[x - k] if x >= k else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) >> 1
                else:
                    e = a + b - c
                    pa_, pb, pc = abs(e - a), abs(e - b), abs(e - c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                out[x] = (line[x] + p) & 255
            line = out
        rows[y], before = line, line
    pixels = rows.reshape(height, width, k)
    if color == 3:
        return palette[pixels[:, :, 0]]
    if color == 0:
        return np.repeat(pixels, 3, axis=2)
    if color == 4:
        return (np.repeat(pixels[:, :, :1], 3, axis=2).astype(np.uint32) * pixels[:, :, 1:] // 255).astype(np.uint8)
    if color == 6:
        return (pixels[:, :, :3].astype(np.uint32) * pixels[:, :, 3:] // 255).astype(np.uint8)
    return pixels


def thin(image: np.ndarray) -> np.ndarray:
    """Every k-th row and column of a large image."""
    side = max(image.shape[:2])
    step = max(1, side // TARGET) if side >= LARGE else 1
    return image[::step, ::step]


def image_histograms(frames: DataFrame, feature: str, *, full: bool = False) -> DataFrame:
    """Columns episode_index, dim, bin, n: pixels of the sampled frames.

    An image that cannot be decoded is an error.  At most 768 rows an episode
    leave the decoding tasks, whatever the size of the images.
    """
    counts = frames.groupBy("episode_index").agg(F.count(F.lit(1)).cast("bigint").alias("__n"))
    wanted = counts.select("episode_index", F.explode(sample_indices(F.col("__n"), full)).alias("frame_index"))
    sampled = frames.join(wanted, ["episode_index", "frame_index"]).select("episode_index", F.col(f"`{feature}`")["bytes"].alias("data"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, np.ndarray] = {}
            for e, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = found.setdefault(e, np.zeros((3, 256), np.int64))
                image = thin(decode_png(data))
                for c in range(3):
                    h[c] += np.bincount(image[:, :, c].ravel(), minlength=256)
            out: list[list] = [[], [], [], []]
            for e, h in found.items():
                for c, v in zip(*np.nonzero(h)):
                    for col, x in zip(out, (e, int(c), int(v), int(h[c, v]))):
                        col.append(x)
            yield pa.RecordBatch.from_pydict({"episode_index": pa.array(out[0], pa.int64()), "dim": pa.array(out[1], pa.int32()), "bin": pa.array(out[2], pa.int32()), "n": pa.array(out[3], pa.int64())})

    return sampled.mapInArrow(decode, "episode_index bigint, dim int, bin int, n bigint").groupBy("episode_index", "dim", "bin").agg(F.sum("n").alias("n"))


def image_stats(frames: DataFrame, feature: str, *, full: bool = False) -> DataFrame:
    """Long statistics of an image feature in 0..1; count is that of frames."""
    from ..operators.stats import STATS, histogram_stats

    pixels = histogram_stats(image_histograms(frames, feature, full=full), ["episode_index", "dim"]).drop("count")
    n = frames.groupBy("episode_index").agg(F.size(sample_indices(F.count(F.lit(1)).cast("bigint"), full)).cast("bigint").alias("count"))
    return pixels.join(n, "episode_index").select("episode_index", F.lit(feature).alias("feature"), "dim", "count", *STATS)
