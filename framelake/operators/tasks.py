"""Task dictionaries and the remapping of task numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indexing import ranked, small


def episode_tasks(frames: DataFrame, task: str = "task") -> DataFrame:
    """Columns episode_index, task, local_index: the distinct tasks of each
    episode in the order of their first frame; a missing task is ''."""
    first = frames.groupBy("episode_index", F.coalesce(task, F.lit("")).alias("task")).agg(F.min("frame_index").alias("seen"))
    w = Window.partitionBy("episode_index").orderBy("seen", "task")
    return first.select("episode_index", "task", (F.row_number().over(w) - 1).cast("bigint").alias("local_index"))


def task_dictionary(tasks_of_episodes: DataFrame) -> DataFrame:
    """Columns task_index, task: all tasks by first episode, then by their
    place in it, from 0."""
    first = tasks_of_episodes.groupBy("task").agg(F.min(F.struct("episode_index", "local_index")).alias("seen"))
    return ranked(first, ["seen.episode_index", "seen.local_index"], "task_index").select("task_index", "task")


def encode_tasks(frames: DataFrame, dictionary: DataFrame, task: str = "task") -> DataFrame:
    """Replaces the task text by its number."""
    d = dictionary.select("task_index", F.col("task").alias("__text"))
    return frames.join(small(d), F.coalesce(F.col(task), F.lit("")) == F.col("__text")).drop("__text", task)


def remap_local(frames: DataFrame, tasks_of_episodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Numbers that are local to an episode become those of the dictionary; a
    number without a task becomes null, for the caller to refuse."""
    to = tasks_of_episodes.alias("e").join(dictionary.alias("d"), F.col("e.task") == F.col("d.task")).select(
        F.col("e.episode_index").alias("episode_index"), F.col("e.local_index").alias("task_index"), F.col("d.task_index").alias("__to")
    )
    return frames.join(small(to), ["episode_index", "task_index"], "left").withColumn("task_index", F.col("__to")).drop("__to")


def union_dictionary(sources: DataFrame) -> DataFrame:
    """One dictionary for several datasets.

    ``sources`` has source (ordinal), task_index and task; the order is that of
    the datasets, then of their own numbers.  Gives task_index, task.
    """
    first = sources.groupBy("task").agg(F.min(F.struct("source", "task_index")).alias("seen"))
    return ranked(first, ["seen.source", "seen.task_index", "task"], "task_index").select("task_index", "task")


def remap_sources(frames: DataFrame, sources: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Numbers of each source become those of the united dictionary; a number
    that its source does not know stays."""
    to = sources.alias("s").join(dictionary.alias("d"), F.col("s.task") == F.col("d.task")).select(F.col("s.source").alias("source"), F.col("s.task_index").alias("task_index"), F.col("d.task_index").alias("__to"))
    return frames.join(small(to), ["source", "task_index"], "left").withColumn("task_index", F.coalesce("__to", "task_index")).drop("__to")


def first_task_gap(dictionary: DataFrame, total: int) -> DataFrame:
    """The smallest number of 0..total-1 that no task has; no row if none."""
    wanted = dictionary.sparkSession.range(total).withColumnRenamed("id", "task_index")
    return wanted.join(dictionary, "task_index", "left_anti").agg(F.min("task_index").alias("task_index")).where(F.col("task_index").isNotNull())
