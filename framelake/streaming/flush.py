"""Steps that arrive as a stream.

Frames are numbered while they arrive: the number of frames and the task list of
an episode are state that outlives the micro-batches, and what was numbered is
appended to a staging table.  An episode ends with a marked row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def numbered(stream: DataFrame, *, episode: str, order: str, task: str, fps: int, last: str | None = None) -> DataFrame:
    """Adds frame_index, timestamp and local_task to each frame of a stream.

    Rows of one episode in a micro-batch are numbered in ``order``; batches
    follow each other.  ``last`` names a boolean column that closes its episode
    and forgets its state; a row of the episode that comes later begins anew.
    Null tasks are the empty task.
    """
    out = T.StructType([*stream.schema.fields, T.StructField("frame_index", T.LongType()), T.StructField("timestamp", T.FloatType()), T.StructField("local_task", T.LongType())])
    state = T.StructType([T.StructField("frames", T.LongType()), T.StructField("tasks", T.ArrayType(T.StringType()))])

    def number(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        frames, tasks = held.get if held.exists else (0, [])
        tasks = list(tasks or [])
        rows = pd.concat(list(parts))  # one episode in one micro-batch, bounded by the trigger
        rows = rows.sort_values(order, kind="stable")
        rows["frame_index"] = range(frames, frames + len(rows))
        rows["timestamp"] = (rows["frame_index"].astype("float32") / float(fps)).astype("float32")
        place = {t: i for i, t in enumerate(tasks)}
        local = []
        for t in rows[task].fillna(""):
            if t not in place:
                place[t] = len(tasks)
                tasks.append(t)
            local.append(place[t])
        rows["local_task"] = local
        if last is not None and rows[last].fillna(False).any():
            held.remove()
        else:
            held.update((frames + len(rows), tasks))
        yield rows[out.names]

    return stream.groupBy(episode).applyInPandasWithState(number, out, state, "append", GroupStateTimeout.NoTimeout)


def staged(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends to the staging table; a batch that is repeated
    after a failure is not written twice (the file sink keeps its log)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def flush_stats(frames: DataFrame, value: str, every: int, *, episode: str = "episode_index") -> DataFrame:
    """Moments of each flush of ``every`` frames, as the partial statistics of
    an episode; ``operators.stats.dataset_stats`` makes them one."""
    part = F.floor(F.col("frame_index") / every).cast("bigint")
    x = F.col(value).cast("double")
    found = frames.groupBy(episode, part.alias("flush")).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.avg(x * x).alias("s"))
    return found.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("s") - F.col("mean") * F.col("mean")))).drop("s")
