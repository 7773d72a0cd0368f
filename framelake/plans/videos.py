"""Placing the videos of episodes: planning on DataFrames, work in tasks.

``videos`` has one row per episode and camera: episode_index, camera, path,
and start and stop in seconds where the video is a part of the file (null where
it is the whole file).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import keys_of
from ..operators import rotation
from ..operators.common import materialize
from ..operators.indexing import small
from ..sources.files import local
from ..sources.media import make_videos

COLUMNS = ("episode_index", "camera", "path", "start", "stop")


def with_sizes(videos: DataFrame) -> DataFrame:
    """Adds mb: the size of the file, or the share of it that a part has."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [os.path.getsize(local(p)) / 2**20 if os.path.exists(local(p)) else None for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.float64())], names=["path", "file_mb"])

    files = videos.select("path").distinct().mapInArrow(read, "path string, file_mb double")
    shared = videos.groupBy("path").agg(F.count(F.lit(1)).alias("users"))
    return videos.join(small(files), "path").join(small(shared), "path").withColumn("mb", F.col("file_mb") / F.col("users")).drop("file_mb", "users")


def missing(videos: DataFrame, episodes: DataFrame, cameras: list[str]) -> DataFrame:
    """Episodes and cameras without a video, or whose file is absent or empty."""
    names = F.array(*[F.lit(c) for c in cameras]) if cameras else F.array().cast("array<string>")
    wanted = episodes.select("episode_index", F.explode(names).alias("camera"))
    there = with_sizes(videos).where(F.col("mb") > 0).select("episode_index", "camera")
    return wanted.join(there, ["episode_index", "camera"], "left_anti")


def plan(videos: DataFrame, episodes: DataFrame, info: L.DatasetInfo) -> DataFrame:
    """Adds to each video its output, place and running time in the new file.

    v2.1 has a file for each episode; v3.0 fills files up to the size limit per
    camera, in the order of the episodes.
    """
    lengths = episodes.select("episode_index", (F.col("length") / F.lit(float(info.fps))).alias("duration"))
    rows = with_sizes(videos).join(small(lengths), "episode_index")
    e = F.col("episode_index")
    if L.parse_version(info.codebase_version) == L.V21:
        out = L.path_column(info.video_path, video_key=F.col("camera"), episode_chunk=L.chunk_of(e, info.chunks_size), episode_index=e)
        return rows.withColumn("output", out).withColumn("from_timestamp", F.lit(0.0)).withColumn("to_timestamp", F.col("duration"))
    filed = rotation.rotate(rows, ["episode_index"], "mb", float(info.video_files_size_in_mb), group=["camera"])
    placed = rotation.places(rotation.media_offsets(filed, ["camera"], "episode_index", "duration"), info.chunks_size)
    return placed.withColumn("output", L.path_column(info.video_path, video_key=F.col("camera"), chunk_index=F.col("chunk_index"), file_index=F.col("file_index")))


def place(videos: DataFrame, episodes: DataFrame, info: L.DatasetInfo, root: str) -> tuple[DataFrame, DataFrame]:
    """Makes the video files under ``root``; gives the episodes with their
    video columns, and the videos as they are now."""
    made = materialize(plan(videos, episodes, info))
    work = made.select(F.concat(F.lit(local(root).rstrip("/") + "/"), "output").alias("output"), F.col("episode_index").alias("ordinal"), F.col("path").alias("input"), "start", "stop")
    make_videos(work, info.fps).collect()  # one row for each file
    old = L.parse_version(info.codebase_version) == L.V21
    whole = F.lit(None).cast("double")
    now = made.select("episode_index", "camera", F.concat(F.lit(root.rstrip("/") + "/"), "output").alias("path"), (whole if old else F.col("from_timestamp")).alias("start"), (whole if old else F.col("to_timestamp")).alias("stop"))
    if old:
        return episodes, now
    for key in keys_of(info.features, "video"):
        mine = made.where(F.col("camera") == key).select("episode_index", *[F.col(c).alias(f"videos/{key}/{c}") for c in ("chunk_index", "file_index", "from_timestamp", "to_timestamp")])
        episodes = episodes.join(mine, "episode_index", "left")
    return episodes, now


def of_dataset(episodes: DataFrame, info: L.DatasetInfo, root: str) -> DataFrame | None:
    """The videos that a written dataset has."""
    keys = keys_of(info.features, "video")
    if not keys or not info.video_path:
        return None
    parts, base = [], F.lit(root.rstrip("/") + "/")
    for key in keys:
        e, null = F.col("episode_index"), F.lit(None).cast("double")
        if L.parse_version(info.codebase_version) == L.V21:
            out, start, stop = L.path_column(info.video_path, video_key=F.lit(key), episode_chunk=L.chunk_of(e, info.chunks_size), episode_index=e), null, null
        else:
            c = lambda n: F.col(f"`videos/{key}/{n}`") if f"videos/{key}/{n}" in episodes.columns else F.lit(None)  # noqa: B023, E731
            out, start, stop = L.path_column(info.video_path, video_key=F.lit(key), chunk_index=c("chunk_index"), file_index=c("file_index")), c("from_timestamp"), c("to_timestamp")
        parts.append(episodes.select(e, F.lit(key).alias("camera"), F.concat(base, out).alias("path"), start.cast("double").alias("start"), stop.cast("double").alias("stop")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # a part that is alone in its file is the whole file
    users = found.groupBy("path").agg(F.count(F.lit(1)).alias("users"))
    alone = found.join(small(users), "path")
    keep = lambda n: F.when(F.col("users") > 1, F.col(n)).alias(n)
    return alone.select("episode_index", "camera", "path", keep("start"), keep("stop"))
