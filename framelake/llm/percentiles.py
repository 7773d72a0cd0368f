"""Exact percentiles of very large numeric columns, and a form that combines.

Method: one distributed sort.  Values are range-partitioned by group, value and
a spreading key (so that neither a hot group nor a hot value has to fit one
task), counted per partition and group, and the counts of the few groups that
cross a partition border, at most two pieces per partition, become offsets.
Each sorted partition then locates the wanted positions of its groups and the
neighbouring order statistics are interpolated exactly.

Error bounds: ``percentiles`` is exact (rank error 0).  ``digests`` keeps
``resolution + 1`` equally spaced order statistics of each group and
``combine_digests`` merges any number of them; a merged percentile is off by at
most ``1 / resolution`` in rank, and by nothing where every part held at most
``resolution + 1`` values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import partitions_for

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)

#: Gives for group sizes n, an int64 array, the wanted 0-based positions as an
#: array of shape (len(n), k); negative or too large positions give null.
Positions = Callable[[np.ndarray], np.ndarray]


def finite_or_zero(c: Column) -> Column:
    """NaN, infinities and -0.0 count as 0; null stays null."""
    d = c.cast("double") + F.lit(0.0)
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(0.0)).otherwise(d)


def _numbered(base: int) -> Callable:
    return lambda x, j: F.struct((F.lit(base) + j).cast("int").alias("series"), finite_or_zero(x).alias("value"))


def unpivot(rows: DataFrame, keep: Sequence[Column], features: dict[str, bool]) -> DataFrame:
    """Long form (keep..., series, value) of scalar and vector columns.

    ``features`` maps a column to whether it is a vector.  ``series`` is the
    position of the feature times 65536 plus the dim; nulls are left out.
    """
    parts = []
    for i, (name, vector) in enumerate(features.items()):
        c = F.col(f"`{name}`")
        arr = F.coalesce(c, F.array().cast("array<float>")) if vector else F.array(c)
        parts.append(F.transform(arr, _numbered(i << 16)))
    return rows.select(*keep, F.inline(F.concat(*parts))).where(F.col("value").isNotNull())


def series_columns(features: Sequence[str]) -> list[Column]:
    """The columns feature and dim of a ``series``."""
    names = F.array(*[F.lit(f) for f in features])
    return [
        F.element_at(names, F.shiftright(F.col("series"), 16) + 1).alias("feature"),
        F.col("series").bitwiseAND(F.lit(65535)).alias("dim"),
    ]


def _changes(col: pa.Array) -> np.ndarray:
    """Where a row's key differs from the row before; nulls equal each other."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if col.null_count:
        differ = differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return differ


def _picker(groups: list[str], positions: Positions, k: int, schema: pa.Schema) -> Callable:
    """Reads one sorted partition (8 bytes a value are held) and picks positions."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts, heads, at, last = [], [], [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            keys = [b.column(g) for g in groups]
            for c in keys:
                new[1:] |= _changes(c)
            first = [c[0].as_py() for c in keys]
            new[0] = first != last
            last = [c[-1].as_py() for c in keys]
            here = np.flatnonzero(new)
            starts.append(here + at)
            heads.append(pa.Table.from_batches([b]).select([*groups, "__off", "__total"]).take(pa.array(here)))
            values.append(b.column("__v").to_numpy(zero_copy_only=False))
            at += b.num_rows
        if not at:
            return
        begin = np.concatenate(starts)
        head = pa.concat_tables(heads).combine_chunks()
        v = np.concatenate(values)
        size = np.diff(np.append(begin, at))
        total = pc.fill_null(head["__total"], -1).to_numpy()
        total = np.where(total < 0, size, total)
        off = pc.fill_null(head["__off"], 0).to_numpy()
        for lo in range(0, len(begin), 50_000):
            s = slice(lo, lo + 50_000)
            want = positions(total[s])
            local = want - off[s, None]
            ok = (want >= 0) & (want < total[s, None]) & (local >= 0) & (local < size[s, None])
            picked = v[np.where(ok, local, 0) + begin[s, None]]
            flat = pa.array(picked.ravel(), mask=~ok.ravel())
            arrays = [head[g].slice(lo, 50_000).combine_chunks() for g in groups]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            offsets = pa.array(np.arange(0, (len(want) + 1) * k, k, dtype=np.int32))
            arrays += [pa.array(total[s]), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return pick


def order_statistics(
    values: DataFrame,
    groups: Sequence[str],
    value: str,
    positions: Positions,
    k: int,
    *,
    spread: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Columns ``groups``, ``n`` and ``stats``, the k wanted order statistics.

    ``spread`` is a deterministic integer over the row that differs among equal
    values: a hot value is divided into as many runs as there are partitions,
    and four times more, so that it fits them however large it is.  Null values are
    ignored; null group keys are a group; an empty input gives no rows.
    """
    groups = list(groups)
    parts = parts or partitions_for(values, 8 << 20)  # unpivoted rows are wider than their scan
    ties = 1 << (4 * parts - 1).bit_length()
    tie = F.lit(0) if spread is None else F.pmod(spread, F.lit(ties))
    v = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"), tie.cast("smallint" if ties <= 1 << 15 else "int").alias("__tie"))
    runs = v.repartitionByRange(parts, *groups, "__v", "__tie").select(*groups, "__v", F.spark_partition_id().alias("__pid"))
    pieces = runs.groupBy(*groups, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups)
    spans = (
        pieces.select(
            *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
            F.col("__pid").alias("__p"),
            F.count(F.lit(1)).over(w).alias("__pieces"),
            (F.sum("__n").over(w.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__off"),
            F.sum("__n").over(w).alias("__total"),
        )
        .where(F.col("__pieces") > 1)
        .drop("__pieces")
    )  # at most two pieces of such groups begin or end in a partition
    cond = F.col("__pid") == F.col("__p")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    ready = (
        runs.join(F.broadcast(spans), cond, "left")
        .select(*groups, "__v", "__off", "__total")
        .sortWithinPartitions(*groups, "__v")
    )
    schema = T.StructType([*[T.StructField(g, values.schema[g].dataType) for g in groups], T.StructField("n", T.LongType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    found = ready.mapInArrow(_picker(groups, positions, k, to_arrow_schema(schema)), schema)
    return (
        found.groupBy(*groups, "n")
        .agg(*[F.max(F.col("stats")[i]).alias(f"__s{i}") for i in range(k)])
        .select(*groups, "n", F.array(*[F.col(f"__s{i}") for i in range(k)]).alias("stats"))
    )


def _neighbours(qs: tuple[float, ...]) -> Positions:
    def positions(n: np.ndarray) -> np.ndarray:
        at = (n[:, None] - 1) * np.asarray(qs)[None, :]
        low = np.floor(at).astype(np.int64)
        return np.concatenate([low, np.minimum(low + 1, n[:, None] - 1)], axis=1)

    return positions


def percentiles(
    values: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float] = QUANTILES, *, spread: Column | None = None
) -> DataFrame:
    """Exact percentiles, interpolated linearly at q * (n - 1): groups, n, q..."""
    qs = tuple(qs)
    k = len(qs)
    found = order_statistics(values, groups, value, _neighbours(qs), 2 * k, spread=spread)
    out = []
    for i, q in enumerate(qs):
        at = (F.col("n") - 1) * F.lit(q)
        low, high = F.col("stats")[i], F.col("stats")[i + k]
        out.append((low + (high - low) * (at - F.floor(at))).alias(f"q{round(q * 100):02d}"))
    return found.select(*groups, "n", *out)


def _grid(resolution: int) -> Positions:
    def positions(n: np.ndarray) -> np.ndarray:
        j = np.arange(resolution + 1)[None, :]
        spaced = j * (n[:, None] - 1) // resolution
        return np.where(n[:, None] <= resolution + 1, j, spaced)

    return positions


def digests(values: DataFrame, groups: Sequence[str], value: str, *, resolution: int = 100, spread: Column | None = None) -> DataFrame:
    """Per group the combinable form: n and equally spaced order statistics."""
    found = order_statistics(values, groups, value, _grid(resolution), resolution + 1, spread=spread)
    return found.select(*groups, "n", F.filter("stats", lambda x: x.isNotNull()).alias("points"))


def combine_digests(parts: DataFrame, groups: Sequence[str], qs: Sequence[float] = QUANTILES, *, resolution: int = 100) -> DataFrame:
    """Percentiles of united digests: groups, n, q..., rank_error (its bound).

    Equal points are added up before the only window, which is over the points
    of a group, ``resolution + 1`` for each part that was combined.
    """
    groups = list(groups)
    m = F.size("points")
    points = parts.select(
        *groups, (F.col("n") / m).alias("w"), F.when(F.col("n") > m, F.col("n") / resolution).otherwise(0.0).alias("e"), F.posexplode("points").alias("j", "v")
    )
    merged = points.groupBy(*groups, "v").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("j") == 0, F.col("e"))).alias("e"))
    w = Window.partitionBy(*groups)
    run = merged.select(
        *groups, "v",
        F.sum("w").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("w").over(w).alias("total"), F.sum("e").over(w).alias("err"),
    )
    picks = [
        F.min(F.when(F.col("upto") + 1e-6 >= F.greatest(F.lit(q) * (F.col("total") - 1) + 1, F.lit(1.0)), F.col("v"))).alias(f"q{round(q * 100):02d}")
        for q in qs
    ]
    return run.groupBy(*groups).agg(F.round(F.max("total")).cast("bigint").alias("n"), *picks, F.coalesce(F.max(F.col("err") / F.col("total")), F.lit(0.0)).alias("rank_error"))


def _rank_borders(n: np.ndarray) -> np.ndarray:
    """Positions that decide whether q10, q50 and q90 are off by 0.10 in rank.

    The share of values below x exceeds p + 0.10 exactly if the value at
    position floor(n (p + 0.10)) is below x; the share of values not above x is
    less than p - 0.10 exactly if the value at ceil(n (p - 0.10)) - 1 is above
    x.  For p = 0.1 and 0.9 the outer border is beyond all values.
    """
    tenths = lambda a, up: (n * a + 9 * up) // 10
    return np.stack([tenths(2, 0), tenths(6, 0), tenths(4, 1) - 1, tenths(8, 1) - 1], axis=1)


def wrong_quantiles(stats: DataFrame, values: DataFrame, groups: Sequence[str], value: str, *, least: int = 20, spread: Column | None = None) -> DataFrame:
    """Distinct ``groups`` of ``stats`` whose q10, q50 or q90 is off by > 0.10.

    Statistics that are null are not off; groups of fewer than ``least`` values
    are not judged; rows without values, or repeated, give nothing more.
    """
    groups = list(groups)
    found = order_statistics(values, groups, value, _rank_borders, 4, spread=spread).where(F.col("n") >= least)
    s = F.col("stats")
    off = (
        F.coalesce(s[0] < F.col("q10"), F.lit(False))
        | F.coalesce(s[1] < F.col("q50"), F.lit(False))
        | F.coalesce(s[2] > F.col("q50"), F.lit(False))
        | F.coalesce(s[3] > F.col("q90"), F.lit(False))
    )
    return stats.select(*groups, "q10", "q50", "q90").join(found, groups).where(off).select(*groups).distinct()
