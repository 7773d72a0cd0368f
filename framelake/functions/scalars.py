"""Scalar functions of the data model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)
QUANTILE_NAMES = tuple(f"q{round(q * 100):02d}" for q in QUANTILES)


def finite(c: Column) -> Column:
    """NaN and infinities become 0 before and after aggregation."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def sample_count(n: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """Frames to sample of n: n ** 0.75 between min(100, n) and 10 000."""
    wanted = F.floor(F.pow(n.cast("double"), F.lit(power)))
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(F.greatest(wanted, F.least(F.lit(least), n)), F.lit(most))).cast("bigint")


def sample_indices(n: Column, full: bool = False) -> Column:
    """Evenly spaced frame indices, both ends included, halves away from 0."""
    if full:
        return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    k = sample_count(n)
    spaced = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5).cast("bigint"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(k <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(spaced)


def frame_time(frame_index: Column, fps: Column | int) -> Column:
    """Seconds of a frame as float32."""
    f = F.lit(fps) if isinstance(fps, int) else fps
    return (frame_index.cast("float") / f.cast("float")).cast("float")


def frame_rate(text: Column) -> Column:
    """'n/d' as a rounded rate, a plain number as it is, '' and 0/0 as 0."""
    n, d = F.split(text, "/")[0].try_cast("double"), F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")
    return F.when(text.contains("/"), F.when(d > 0, F.floor(n / d + 0.5).cast("double")).otherwise(0.0)).otherwise(F.coalesce(n, F.lit(0.0)))


def pixel_channels(pix_fmt: Column) -> Column:
    """Channels of a pixel format; null for formats that are not known."""
    has = lambda *names: _any([pix_fmt.contains(n) for n in names])
    return F.when(has("gray", "depth", "monochrome"), 1).when(has("rgba", "yuva"), 4).when(has("rgb", "yuv"), 3)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def safe_key(key: Column) -> Column:
    return F.regexp_replace(key, "[^A-Za-z0-9]", "_")


def unit_channels(channels: Column) -> Column:
    """Byte statistics of channels as the nested (C, 1, 1) form in 0..1."""
    return F.transform(channels, lambda v: F.array(F.array(v / 255.0)))


def first_number(c: Column) -> Column:
    """First element of a list, or -1 where there is none."""
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(-1.0))


def key_values(text: Column) -> Column:
    """A map from lines of the form key=value."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("="))
    return F.map_from_arrays(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, "^([^=]*)=", 1))), F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^[^=]*=", ""))))
