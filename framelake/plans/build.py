"""From raw steps to a dataset: numbering, tasks, statistics, files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import Features, check_columns, check_media, data_columns, keys_of, owned_features, parse_stats_mode, same_schema, spark_type, with_defaults
from ..functions.images import image_stats
from ..operators import indexing as X
from ..operators import rotation, stats, tasks
from ..operators.common import materialize
from ..sources.dataset import Dataset
from ..sources.sinks import write_dataset


def row_bytes(features: Features) -> Column:
    """Uncompressed bytes of a frame: fixed widths, and the lengths of texts and
    images."""
    width = {"float32": 4, "float64": 8, "int64": 8, "int32": 4, "bool": 1}
    fixed, varying = 0, []
    for name in data_columns(features):
        spec = features[name]
        if spec.dtype in width:
            n = 1
            for k in spec.shape:
                n *= k
            fixed += n * width[spec.dtype]
        elif spec.dtype == "image":
            varying.append(F.coalesce(F.octet_length(F.col(f"`{name}`")["bytes"]), F.lit(0)))
        else:
            varying.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)))
    out = F.lit(fixed)
    for c in varying:
        out = out + c
    return out.cast("double")


def assign_data_files(lengths: DataFrame, info: L.DatasetInfo, *, most: int = 0) -> DataFrame:
    """Adds data/chunk_index and data/file_index to episodes with ``mb``."""
    filed = rotation.rotate(lengths, ["episode_index"], "mb", float(info.data_files_size_in_mb), most=most)
    placed = rotation.places(filed, info.chunks_size)
    return placed.withColumnsRenamed({"chunk_index": "data/chunk_index", "file_index": "data/file_index"}).drop("file")


def build(
    steps: DataFrame, features: Features, fps: int, *, episode: str, order: Sequence[str], task: str | None, version: str = L.V30,
    robot_type: str | None = None, use_videos: bool = True, episodes_per_file: int = 0, with_stats: bool = True, full_images: bool = False, stats_mode: str | None = None, videos: DataFrame | None = None, **limits: int,
) -> Dataset:
    """A dataset from raw rows: one episode for each value of ``episode``.

    Episodes are numbered in the order of their values, frames by ``order``,
    which must be total.  A missing task is the empty one.  Statistics are made
    once, from the final numbers; those of images from sampled frames, or from all
    with ``full_images``; ``stats_mode`` (sampled, full, none) says both in one.
    A null in a feature's column is an error when it is saved.  ``videos`` has the videos of the final episode
    numbers (see ``plans.videos``).
    """
    check_media(features, use_videos)
    if stats_mode is not None:
        mode = parse_stats_mode(stats_mode)
        with_stats, full_images = mode != "none", mode == "full"
    others = tuple({episode, task or "task", *order})
    check_columns([c for c in steps.columns if c not in others or c in features], features, others=others)
    info = L.DatasetInfo.new(version, fps, features, robot_type=robot_type, **limits)
    numbers = X.dense_index(steps, episode, "episode_index").withColumnRenamed(episode, "__e") if episode != "episode_index" else X.dense_index(steps, episode, "__n").withColumnRenamed(episode, "__e").withColumnRenamed("__n", "episode_index")
    named = steps.withColumn("__task", F.coalesce(F.col(task), F.lit("")) if task else F.lit(""))
    drop = [c for c in ("episode_index", "frame_index", "timestamp", "index", "task_index") if c in steps.columns and c != episode and c not in order]
    source = named.drop(*drop).withColumnRenamed(episode, "__key")
    keyed = [("__key" if o == episode else o) for o in order]
    joined = source.join(X.small(numbers), F.col("__key") == F.col("__e")).drop("__e", "__key")
    framed = X.frame_index(joined, "episode_index", [o for o in keyed if o != "__key"])
    framed = X.with_timestamp(framed, fps)
    # one pass over the numbered frames gives tasks, lengths and sizes
    bytes_ = F.sum(row_bytes(features)).alias("bytes")
    seen = materialize(framed.groupBy("episode_index", F.col("__task").alias("task")).agg(F.min("frame_index").alias("frame_index"), F.count(F.lit(1)).alias("n"), bytes_))
    per_episode = materialize(tasks.episode_tasks(seen))
    dictionary = materialize(tasks.task_dictionary(per_episode))
    sizes = seen.groupBy("episode_index").agg(F.sum("n").alias("length"), (F.sum("bytes") / 2**20).alias("mb"))
    ranges = X.running_sum(sizes, "episode_index", "length", "dataset_to_index").withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("length"))
    placed = materialize(assign_data_files(ranges, info, most=episodes_per_file))
    texts = per_episode.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("local_index", "task"))), lambda x: x["task"]).alias("tasks"))
    episodes = placed.join(texts, "episode_index").select("episode_index", "tasks", "length", "dataset_from_index", "dataset_to_index", "data/chunk_index", "data/file_index")
    frames = tasks.encode_tasks(X.global_index(framed, placed), dictionary, "__task")
    typed = frames.select(*[F.col(f"`{c}`").cast(spark_type(info.features[c])).alias(c) for c in data_columns(info.features)])
    totals = placed.agg(F.count(F.lit(1)), F.sum("length"), F.max("`data/chunk_index`")).first()
    n_tasks = dictionary.count()
    info = replace(info, total_episodes=totals[0], total_frames=totals[1] or 0, total_tasks=n_tasks)
    if info.codebase_version == L.V21:
        cameras = sum(v.dtype == "video" for v in features.values())
        info = replace(info, total_chunks=max(0, -(-info.total_episodes // info.chunks_size)), total_videos=cameras * info.total_episodes)
    derive = stats.numeric_features(info.features) if with_stats else None
    images = tuple(keys_of(info.features, "image")) if with_stats else ()
    return Dataset(info, typed, episodes, dictionary, None, derive=derive, videos=videos, images=images, full_images=full_images)


def save(dataset: Dataset, root: str, *, force: bool = False) -> Dataset:
    """Writes a dataset to an empty folder, with its statistics."""
    place = root.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(place) and os.listdir(place) and not force:
        raise FileExistsError(f"{root} is not empty")
    return write_dataset(dataset, root)


def convert(dataset: Dataset, version: str, **limits: int) -> Dataset:
    """The same data in the other layout; statistics are carried along."""
    version = L.parse_version(version)
    if L.parse_version(dataset.info.codebase_version) == version:
        raise ValueError(f"the dataset is {version} already")
    info = replace(dataset.info.to_version(version), **limits)
    base = dataset.episodes.select("episode_index", "tasks", "length", "dataset_from_index", "dataset_to_index")
    if version == L.V30:
        sizes = dataset.frames.groupBy("episode_index").agg((F.sum(row_bytes(info.features)) / 2**20).alias("mb"))
        base = assign_data_files(base.join(sizes, "episode_index"), info).drop("mb")
    else:
        cameras = sum(v.dtype == "video" for v in info.features.values())
        info = replace(info, total_chunks=-(-info.total_episodes // max(1, info.chunks_size)), total_videos=cameras * info.total_episodes)
    return Dataset(info, dataset.frames, materialize(base), dataset.tasks, dataset.stats, derive=dataset.derive, videos=dataset.videos, images=dataset.images, full_images=dataset.full_images)


def check_compatible(infos: Sequence[L.DatasetInfo]) -> None:
    """At least two datasets, with the same fps, robot and features."""
    from ..functions.features import features_equal

    if len(infos) < 2:
        raise ValueError("at least two datasets are needed")
    first = infos[0]
    for other in infos[1:]:
        if other.fps != first.fps:
            raise ValueError(f"fps {other.fps} and {first.fps}")
        if other.robot_type != first.robot_type:
            raise ValueError(f"robot_type {other.robot_type!r} and {first.robot_type!r}")
        if not features_equal(with_defaults(other.features), with_defaults(first.features)):
            raise ValueError("features differ")


REINDEXED = ("index", "episode_index", "task_index")


def union(datasets: Sequence[Dataset], version: str = L.V30, **limits: int) -> Dataset:
    """One dataset of several, in their order.

    Episodes and indices follow on, tasks are united by their text in the order
    of the datasets.  Statistics are carried, those of the numbers made anew.
    """
    check_compatible([d.info for d in datasets])
    version = L.parse_version(version)
    info = replace(datasets[0].info.to_version(version), **limits)
    cols = data_columns(info.features)
    parts: dict[str, list[DataFrame]] = {"frames": [], "episodes": [], "tasks": [], "stats": [], "videos": []}
    first_episode = first_index = 0
    for ordinal, d in enumerate(datasets):
        shift = lambda c, by: (F.col(c) + F.lit(by)).cast("bigint").alias(c)
        moved = {"episode_index": first_episode, "index": first_index}
        parts["frames"].append(d.frames.select(*[shift(c, moved[c]) if c in moved else F.col(f"`{c}`") for c in cols], F.lit(ordinal).alias("source")))
        parts["episodes"].append(d.episodes.select(shift("episode_index", first_episode), "tasks", "length", shift("dataset_from_index", first_index), shift("dataset_to_index", first_index)))
        parts["tasks"].append(d.tasks.select(F.lit(ordinal).alias("source"), "task_index", "task"))
        if d.videos is not None:
            parts["videos"].append(d.videos.select(shift("episode_index", first_episode), "camera", "path", "start", "stop"))
        carried = d.long_stats()
        if carried is not None:
            parts["stats"].append(carried.where(~F.col("feature").isin(*REINDEXED)).withColumn("episode_index", F.col("episode_index") + F.lit(first_episode)))
        first_episode += d.info.total_episodes
        first_index += d.info.total_frames
    joined = {k: _union(v) for k, v in parts.items() if v}
    dictionary = materialize(tasks.union_dictionary(joined["tasks"]))
    frames = tasks.remap_sources(joined["frames"], joined["tasks"], dictionary).select(*[F.col(f"`{c}`") for c in cols])
    sizes = frames.groupBy("episode_index").agg((F.sum(row_bytes(info.features)) / 2**20).alias("mb"))
    episodes = joined["episodes"]
    if version == L.V30:
        episodes = assign_data_files(episodes.join(sizes, "episode_index"), info).drop("mb")
    long = joined.get("stats")
    cameras = sum(v.dtype == "video" for v in info.features.values())
    info = replace(info, total_episodes=first_episode, total_frames=first_index, total_tasks=dictionary.count())
    if version == L.V21:
        info = replace(info, total_chunks=-(-first_episode // max(1, info.chunks_size)), total_videos=cameras * first_episode)
    return Dataset(info, frames, materialize(episodes), dictionary, long, derive={c: 0 for c in REINDEXED}, videos=joined.get("videos"))


def _union(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema, strictly; nullability, which differs with how a
    table was made, and metadata do not count."""
    out = parts[0]
    for p in parts[1:]:
        if not same_schema(out.schema, p.schema, nullable=False):
            raise ValueError(f"schemas differ: {out.schema.simpleString()} and {p.schema.simpleString()}")
        out = out.union(p)
    return out


def complete_media(dataset: Dataset, given: DataFrame | None = None, *, external_videos: bool = False, full: bool = False) -> Dataset:
    """Fills in statistics of images and videos that a dataset lacks.

    Those of images are made from the frames, only of the episodes that lack
    them; those of videos come from ``given`` (long form), as no decoder is at
    hand, unless the caller keeps them with ``external_videos``.  What is there
    already is kept.  Episodes that still lack any are an error.
    """
    owned = owned_features(dataset.info.features, external_videos)
    media = [k for k, v in owned.items() if v.media]
    if not media:
        return dataset
    have = dataset.stats
    every = dataset.episodes.select("episode_index", F.explode(F.array(*[F.lit(k) for k in sorted(media)])).alias("feature"))
    lack = materialize(every if have is None else every.join(have.select("episode_index", "feature").distinct(), ["episode_index", "feature"], "left_anti"))
    made = [] if have is None else [have]
    for key in keys_of(owned, "image"):
        wanted = lack.where(F.col("feature") == key).select("episode_index")
        if wanted.limit(1).count():
            made.append(image_stats(dataset.frames.join(X.small(wanted), "episode_index", "left_semi"), key, full=full))
    if given is not None:
        made.append(given.join(lack.where(~F.col("feature").isin(*keys_of(owned, "image"))), ["episode_index", "feature"], "left_semi"))
    whole = made[0] if made else None
    for m in made[1:]:
        whole = whole.unionByName(m)
    still = lack if whole is None else lack.join(whole.select("episode_index", "feature").distinct(), ["episode_index", "feature"], "left_anti")
    first = still.orderBy("episode_index", "feature").first()
    if first is not None:
        raise ValueError(f"episode {first[0]}: no statistics of {first[1]}")
    return replace(dataset, stats=whole, images=())
