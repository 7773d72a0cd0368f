"""Frame numbers, time stamps, global indices and episode ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import frame_time
from .common import BROADCAST_ROWS, materialize

#: Rows of one block of a two-level running sum.
BLOCK = 4096


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in a total order of all rows.

    Rows are range-partitioned by the order and kept, so that a place is that in
    the partition and the sizes of the partitions before: no task sees all rows.
    """
    cols = [F.col(c) for c in order]
    kept = materialize(rows.repartitionByRange(*cols)).withColumn("__p", F.spark_partition_id())
    sizes = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row for each partition
    placed = kept.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*cols)) - 1)
    return placed.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + F.col("__k")).cast("bigint")).drop("__p", "__k", "__before")


def dense_index(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Number the distinct values of ``key`` from 0 in their order."""
    return ranked(rows.select(key).where(F.col(key).isNotNull()).distinct(), [f"`{key}`"], name)


def frame_index(frames: DataFrame, episode: str, order: Sequence[str]) -> DataFrame:
    """Adds frame_index, the position of a frame in its episode from 0.

    ``order`` must be total.  An episode is one recording, so its window is as
    long as a recording, whatever the number of episodes.
    """
    w = Window.partitionBy(episode).orderBy(*order)
    return frames.withColumn("frame_index", (F.row_number().over(w) - 1).cast("bigint"))


def with_timestamp(frames: DataFrame, fps: int) -> DataFrame:
    return frames.withColumn("timestamp", frame_time(F.col("frame_index"), fps))


def running_sum(rows: DataFrame, order: str, value: str, name: str, *, group: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Adds the inclusive running sum of ``value`` in the order of an integer.

    Two levels: a window inside blocks of ``block`` consecutive integers, and
    one over the sums of the blocks, so that no task sees all rows.
    """
    group = list(group)
    cut = rows.withColumn("__b", F.floor(F.col(order) / F.lit(block)))
    inner = Window.partitionBy(*group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*group, "__b").agg(F.sum(value).alias("__s"))
    before = sums.select(*group, "__b", (F.sum("__s").over(over) - F.col("__s")).alias("__before"))
    joined = cut.withColumn("__run", F.sum(value).over(inner)).join(before, [*group, "__b"])
    return joined.withColumn(name, F.col("__run") + F.col("__before")).drop("__b", "__run", "__before")


def episode_ranges(frames: DataFrame, episode: str = "episode_index") -> DataFrame:
    """Columns episode, length, dataset_from_index, dataset_to_index."""
    lengths = frames.groupBy(episode).agg(F.count(F.lit(1)).alias("length"))
    run = running_sum(lengths, episode, "length", "dataset_to_index")
    return run.select(episode, "length", (F.col("dataset_to_index") - F.col("length")).alias("dataset_from_index"), "dataset_to_index")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast a table whose rows were counted and are few; larger
    tables are joined by a shuffle, where the planner splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def global_index(frames: DataFrame, ranges: DataFrame, episode: str = "episode_index") -> DataFrame:
    """Adds index, the frame's place among all frames of all episodes: the
    window is over episodes, and frames only add their own number."""
    starts = ranges.select(episode, "dataset_from_index")
    return frames.join(small(starts), episode).withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index")


def contiguity(frames: DataFrame, episode: str = "episode_index", index: str = "index") -> DataFrame:
    """Per episode: first and last index, rows, gaps, and whether it begins
    where the episode before it ends."""
    per = frames.groupBy(episode).agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(index).alias("n_rows"), F.countDistinct(index).alias("n_distinct"))
    run = running_sum(per, episode, "n_rows", "__upto")
    return run.select(
        episode, "first_index", "last_index", "n_rows",
        ((F.col("last_index") - F.col("first_index") + 1 == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows"))).alias("contiguous"),
        (F.col("first_index") == F.col("__upto") - F.col("n_rows")).alias("starts_right"),
    )


def chain_errors(episodes: DataFrame) -> DataFrame:
    """Episodes whose range does not follow the one before, is not as long as
    the episode, or whose number occurs twice."""
    w = Window.partitionBy(F.floor(F.col("episode_index") / BLOCK)).orderBy("episode_index", "dataset_from_index", "dataset_to_index")
    b = F.floor(F.col("episode_index") / BLOCK)
    inner = episodes.withColumn("__b", b).withColumn("__p", F.lag("dataset_to_index").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    last = episodes.withColumn("__b", b).groupBy("__b").agg(F.max(F.struct("episode_index", "dataset_from_index", "dataset_to_index")).alias("__l"))
    prior = last.select("__b", F.lag(F.col("__l.dataset_to_index"), 1, 0).over(Window.orderBy("__b")).alias("__before"))
    seen = inner.join(prior, "__b").withColumn("previous_to", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__p")))
    twice = episodes.groupBy("episode_index").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    checked = seen.join(twice, "episode_index").select(
        "episode_index", (F.col("dataset_from_index") != F.col("previous_to")).alias("broken_chain"),
        (F.col("dataset_to_index") - F.col("dataset_from_index") != F.col("length")).alias("wrong_length"), "duplicate",
    )
    return checked.where(F.col("broken_chain") | F.col("wrong_length") | F.col("duplicate"))


def timestamp_steps(frames: DataFrame, fps: int, *, episode: str = "episode_index", tolerance: float = 1e-3) -> DataFrame:
    """First frame of each episode whose step in time is neither 1/fps nor 0."""
    w = Window.partitionBy(episode).orderBy("index")
    delta = F.col("timestamp").cast("double") - F.lag(F.col("timestamp").cast("double")).over(w)
    bad = frames.withColumn("delta", delta).where((F.abs(F.col("delta") - 1.0 / fps) > tolerance) & (F.abs(F.col("delta")) > tolerance))
    return bad.groupBy(episode).agg(F.min(F.struct("index", "delta")).alias("b")).select(episode, F.col("b.index").alias("index"), F.col("b.delta").alias("delta"))


def slice_range(frames: DataFrame, start: int, stop: int, index: str = "index") -> DataFrame:
    """Frames with start <= index < stop; the filter reaches the scan."""
    return frames.where((F.col(f"`{index}`") >= start) & (F.col(f"`{index}`") < stop))


def check_slice(frames: DataFrame, start: int, stop: int, index: str = "index") -> DataFrame:
    """The slice, or an error if it is not exactly one row for each index."""
    part = slice_range(frames, start, stop, index)
    n, lo, hi = part.agg(F.count(F.lit(1)), F.min(f"`{index}`"), F.max(f"`{index}`")).first()
    if stop <= start or n != stop - start or lo != start or hi != stop - 1:
        raise ValueError(f"index range [{start}, {stop}) holds {n} rows")
    return part


def replace_column(frames: DataFrame, name: str, value: Column) -> DataFrame:
    """A column by an expression; it must be there already."""
    if name not in frames.columns:
        raise ValueError(f"no column {name!r}")
    return frames.withColumn(name, value)
