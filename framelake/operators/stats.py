"""Statistics of episodes and of datasets.

The long form has one row for each episode, feature and dim with count, min,
max, mean, std, q01, q10, q50, q90 and q99.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.scalars import QUANTILE_NAMES, QUANTILES, finite

MOMENTS = ("min", "max", "mean", "std")
STATS = (*MOMENTS, *QUANTILE_NAMES)


def numeric_features(features: Features) -> dict[str, int]:
    """Features that have statistics, with their rank: text and media have none."""
    return {k: 0 if v.scalar else len(v.shape) for k, v in features.items() if v.numeric and v.dtype not in ("bool", "int32")}


def _flat(c: Column, rank: int) -> Column:
    for _ in range(rank - 1):
        c = F.flatten(c)
    return c if rank else F.array(c)


def _labelled(name: str) -> Callable:
    return lambda x, i: F.struct(F.lit(name).alias("feature"), i.cast("int").alias("dim"), finite(x).alias("x"))


def long_values(frames: DataFrame, features: Mapping[str, int], keep: Sequence[str]) -> DataFrame:
    """Columns keep..., feature, dim, x: one row for each number of a frame.

    ``features`` maps a column to its rank: 0 for scalars, 1 for vectors, more
    for tensors, which count as flat vectors.  Nulls are left out, NaN and
    infinities become 0.
    """
    parts = [F.transform(F.coalesce(_flat(F.col(f"`{n}`"), r).cast("array<double>"), F.array().cast("array<double>")), _labelled(n)) for n, r in features.items()]
    return frames.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.concat(*parts))).where(F.col("x").isNotNull())


def summarise(values: DataFrame, groups: Sequence[str], x: str = "x") -> DataFrame:
    """The statistics of a column of numbers per group.

    std is that of the population, from the moments and never negative;
    percentiles are exact and interpolated at q (n - 1).  The moments combine on
    the map side; the percentiles keep a count for each distinct value of the
    group, which an episode bounds.
    """
    q = F.percentile(x, F.array(*[F.lit(v) for v in QUANTILES]))
    mean, square = F.avg(x), F.avg(F.col(x) * F.col(x))
    found = values.groupBy(*groups).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"), square.alias("__s"), q.alias("__q"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("__s") - F.col("mean") * F.col("mean")))
    return found.select(*groups, "count", "min", "max", "mean", std.alias("std"), *[F.col("__q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)])


def episode_stats(frames: DataFrame, features: Mapping[str, int], episode: str = "episode_index") -> DataFrame:
    return summarise(long_values(frames, features, [episode]), [episode, "feature", "dim"])


def dataset_stats(stats: DataFrame, groups: Sequence[str] = ("feature", "dim")) -> DataFrame:
    """Statistics of all episodes from those of each.

    Mean and std are weighted by count; a percentile is the weighted mean of the
    episodes' percentiles (of their means where one is missing), which is not
    the percentile of all values.  Groups without any count give zeros.
    """
    c = F.coalesce(F.col("count"), F.lit(0)).cast("double")
    total = F.sum(c)
    spread = (F.col("std") * F.col("std") + F.col("mean") * F.col("mean")) * c
    aggregates = [F.min(F.when(c > 0, F.col("min"))).alias("min"), F.max(F.when(c > 0, F.col("max"))).alias("max"), total.cast("bigint").alias("count"), (F.sum(F.col("mean") * c) / F.when(total > 0, total)).alias("mean"), (F.sum(spread) / F.when(total > 0, total)).alias("__s")]
    aggregates += [(F.sum(F.coalesce(F.col(n), F.col("mean")) * c) / F.when(total > 0, total)).alias(n) for n in QUANTILE_NAMES]
    found = stats.groupBy(*groups).agg(*aggregates)
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("__s") - F.col("mean") * F.col("mean")))
    zero = lambda n: F.coalesce(finite(F.col(n)), F.lit(0.0)).alias(n)
    return found.select(*groups, "count", zero("min"), zero("max"), zero("mean"), F.coalesce(std, F.lit(0.0)).alias("std"), *[zero(n) for n in QUANTILE_NAMES])


def sanitise_stats(stats: DataFrame) -> DataFrame:
    """Outputs that are not finite become 0."""
    return stats.select(*[finite(F.col(c)).alias(c) if c in STATS else F.col(c) for c in stats.columns])


def overlay(base: DataFrame, over: DataFrame, keys: Sequence[str] = ("episode_index", "feature", "dim")) -> DataFrame:
    """All features of both tables; where both have one, ``over`` wins whole."""
    per = [k for k in keys if k != "dim"]
    kept = base.join(over.select(*per).distinct(), per, "left_anti")
    return kept.unionByName(over)


def missing_media(features: Features, have: DataFrame, keys: Sequence[str] = ("episode_index",)) -> DataFrame:
    """Declared image and video features without statistics, per episode."""
    declared = sorted(k for k, v in features.items() if v.media)
    names = F.array(*[F.lit(k) for k in declared]) if declared else F.array().cast("array<string>")
    wanted = have.select(*keys).distinct().select(*keys, F.explode(names).alias("feature"))
    return wanted.join(have.select(*keys, "feature").distinct(), [*keys, "feature"], "left_anti")


def flatten_stats(stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per episode with columns ``stats/<feature>/<stat>``: the long
    form as arrays over dims; a feature that an episode lacks is null."""
    by_dim = F.map_from_entries(F.collect_list(F.struct("dim", F.struct("count", *STATS))))
    per = stats.groupBy(F.col("episode_index").alias("__episode"), "feature").agg(by_dim.alias("m"), F.max("dim").alias("last"))
    # a dim that is missing is a null at its place
    per = per.withColumn("v", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at(F.col("m"), i)))
    wide = per.groupBy("__episode").pivot("feature", sorted(features)).agg(F.first("v"))
    cols = []
    for f in sorted(features):
        v = F.col(f"`{f}`")
        cols += [F.transform(v, _member(s)).alias(f"stats/{f}/{s}") for s in STATS]
        cols.append(F.when(v.isNotNull(), F.array(F.array_max(F.transform(v, _member("count"))))).alias(f"stats/{f}/count"))
    return wide.select(F.col("__episode").alias("episode_index"), *cols)


def _member(name: str) -> Callable:
    return lambda x: x[name]


def unflatten_stats(wide: DataFrame) -> DataFrame:
    """The long form from columns ``stats/<feature>/<stat>``; a feature's name
    may hold further slashes, and nested image statistics are made flat."""
    by: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if c.startswith("stats/"):
            feature, stat = c[6:].rsplit("/", 1)
            by.setdefault(feature, {})[stat] = c
    if not by:
        raise ValueError("no columns stats/<feature>/<stat>")
    parts = []
    for feature, cols in by.items():
        depth = {c: str(wide.schema[c].dataType).count("ArrayType") for c in cols.values()}

        def value(stat: str) -> Column:
            c = F.col(f"`{cols[stat]}`") if stat in cols else F.lit(None).cast("array<double>")
            for _ in range(depth.get(cols.get(stat, ""), 1) - 1):
                c = F.flatten(c)
            return c

        count = value("count")[0] if "count" in cols else F.lit(None).cast("bigint")
        first = value("mean") if "mean" in cols else value("min")
        parts.append(
            wide.where(first.isNotNull()).select("episode_index", F.lit(feature).alias("feature"), count.cast("bigint").alias("count"), F.posexplode(first).alias("dim", "__v"), *[value(s).alias(f"__{s}") for s in STATS])
            .select("episode_index", "feature", "dim", "count", *[F.get(F.col(f"__{s}"), F.col("dim")).cast("double").alias(s) for s in STATS])
            .where(F.coalesce(*STATS).isNotNull())
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def histogram_stats(histogram: DataFrame, groups: Sequence[str], *, bin: str = "bin", n: str = "n", unit: float = 255.0) -> DataFrame:
    """Exact statistics of byte values from their histogram, scaled to 0..1.

    ``histogram`` has one row for each group and byte value with its number of
    pixels: at most 256 rows a group, however many pixels there are.
    """
    hist = histogram.groupBy(*groups, F.col(bin).cast("int").alias("b")).agg(F.sum(n).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("b", "n")))
    per = hist.groupBy(*groups).agg(F.sum("n").alias("count"), F.min("b").alias("lo"), F.max("b").alias("hi"), F.sum(F.col("b") * F.col("n")).alias("s1"), F.sum(F.col("b") * F.col("b") * F.col("n")).alias("s2"), pairs.alias("pairs"))
    mean = F.col("s1") / F.col("count")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("count") - mean * mean))

    def at(position: Column) -> Column:
        step = lambda acc, p: F.struct((acc["seen"] + p["n"]).alias("seen"), F.when(acc["v"].isNull() & (acc["seen"] + p["n"] > position), p["b"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("pairs", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("v")), step)["v"]

    qs = []
    for q, name in zip(QUANTILES, QUANTILE_NAMES):
        place = (F.col("count") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.least(F.floor(place) + 1, F.col("count") - 1))
        qs.append(((low + (high - low) * (place - F.floor(place))) / unit).alias(name))
    return per.select(*groups, "count", (F.col("lo") / unit).alias("min"), (F.col("hi") / unit).alias("max"), (mean / unit).alias("mean"), (std / unit).alias("std"), *qs)
