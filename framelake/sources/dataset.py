"""Reading datasets of both layouts into one model."""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import keys_of
from ..functions.images import image_stats
from ..operators.indexing import running_sum
from ..operators.stats import STATS, episode_stats, unflatten_stats
from .files import local, normalise_images


@dataclass
class Dataset:
    """frames, episodes, tasks and long statistics, with what info.json says.

    ``derive`` names features (with their rank) whose statistics are yet to be
    made from the frames; writing makes them from the files just written.
    ``images`` names the image features likewise, of sampled or all frames.
    """

    info: L.DatasetInfo
    frames: DataFrame
    episodes: DataFrame
    tasks: DataFrame
    stats: DataFrame | None = None
    root: str | None = None
    derive: dict[str, int] | None = None
    videos: DataFrame | None = None
    images: tuple[str, ...] = ()
    full_images: bool = False

    def long_stats(self) -> DataFrame | None:
        """All statistics, those to be derived included."""
        out = self.stats
        made = [episode_stats(self.frames, self.derive)] if self.derive else []
        for m in made + [image_stats(self.frames, k, full=self.full_images) for k in self.images]:
            out = m if out is None else out.unionByName(m)
        return out


EMPTY_STATS = "episode_index bigint, feature string, dim int, count bigint, " + ", ".join(f"{s} double" for s in STATS)


def load_info(root: str) -> L.DatasetInfo:
    with open(os.path.join(local(root), L.INFO)) as f:
        return L.DatasetInfo.from_json(f.read())


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON of any length; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_tasks(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Columns task_index, task; parquet may keep the text in a pandas index."""
    if version == L.V21:
        return read_json_lines(spark, f"{root}/{L.OLD_TASKS}", "task_index bigint, task string")
    t = spark.read.parquet(f"{root}/{L.TASKS}")
    text = "task" if "task" in t.columns else "__index_level_0__"
    return t.select(F.col("task_index").cast("bigint").alias("task_index"), F.col(text).alias("task"))


def read_old_stats(spark: SparkSession, root: str) -> DataFrame:
    """Long statistics from JSON lines; values may be nested lists or numbers."""
    rows = read_json_lines(spark, f"{root}/{L.OLD_STATS}", "episode_index bigint, stats map<string, map<string, string>>")
    per = rows.select("episode_index", F.explode("stats").alias("feature", "m"))
    numbers = lambda s: F.transform(F.split(F.regexp_replace(F.col("m")[s], r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return per.select("episode_index", "feature", numbers("count")[0].cast("bigint").alias("count"), F.posexplode(numbers("mean")).alias("dim", "__m"), *[numbers(s).alias(f"__{s}") for s in STATS]).select(
        "episode_index", "feature", "dim", "count", *[F.get(F.col(f"__{s}"), F.col("dim")).alias(s) for s in STATS]
    )


def read_dataset(spark: SparkSession, root: str) -> Dataset:
    """A dataset of either layout; the frames are scanned with the columns that
    are asked for, and filters on index or episode_index reach the scan."""
    from ..plans.videos import of_dataset

    info = load_info(root)
    version = L.parse_version(info.codebase_version)
    frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    frames = normalise_images(frames, [k for k in keys_of(info.features, "image") if k in frames.columns])
    tasks = read_tasks(spark, root, version)
    if version == L.V21:
        rows = read_json_lines(spark, f"{root}/{L.OLD_EPISODES}", "episode_index bigint, tasks array<string>, length bigint")
        run = running_sum(rows, "episode_index", "length", "dataset_to_index")
        episodes = run.withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("length"))
        has = os.path.exists(os.path.join(local(root), L.OLD_STATS))
        stats = read_old_stats(spark, root) if has else spark.createDataFrame([], EMPTY_STATS)
        return Dataset(info, frames, episodes, tasks, stats, root, videos=of_dataset(episodes, info, root))
    meta = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    zero = lambda c: (F.coalesce(F.col(f"`{c}`"), F.lit(0)) if c in meta.columns else F.lit(0)).cast("bigint").alias(c)
    numbers = ["dataset_from_index", "dataset_to_index", "data/chunk_index", "data/file_index"]
    videos = [F.col(f"`{c}`") for c in meta.columns if c.startswith("videos/")]
    episodes = meta.select("episode_index", "tasks", "length", *[zero(c) for c in numbers], *videos)
    try:
        stats = unflatten_stats(meta)
    except ValueError:
        stats = spark.createDataFrame([], EMPTY_STATS)
    return Dataset(info, frames, episodes, tasks, stats, root, videos=of_dataset(episodes, info, root))


def data_files(root: str, info: L.DatasetInfo, episodes: DataFrame | None = None) -> list[str]:
    """Data files there are, in order; v2.1 names one for each episode."""
    base = local(root)
    if L.parse_version(info.codebase_version) == L.V21:
        return [info.episode_path(e) for e in range(info.total_episodes)]
    return sorted(os.path.relpath(p, base) for p in glob.glob(f"{base}/data/chunk-*/file-*.parquet"))


def episode_files(episodes: DataFrame, root: str) -> DataFrame:
    """Adds path, the data file of each episode: the pruning of a read of few
    episodes is to read only the paths of theirs."""
    path = L.path_column(L.DATA_PATH[L.V30], chunk_index=F.col("`data/chunk_index`"), file_index=F.col("`data/file_index`"))
    return episodes.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), path))


def read_episodes(spark: SparkSession, dataset: Dataset, wanted: list[int]) -> DataFrame:
    """Frames of a few episodes, from only the files that hold them."""
    if L.parse_version(dataset.info.codebase_version) == L.V21:
        paths = [f"{dataset.root}/{dataset.info.episode_path(e)}" for e in wanted]
    else:
        rows = episode_files(dataset.episodes.where(F.col("episode_index").isin(wanted)), dataset.root).select("path").distinct()
        paths = sorted(r[0] for r in rows.limit(len(wanted)).collect())  # at most one for each wanted episode
    return spark.read.parquet(*paths).where(F.col("episode_index").isin(wanted))
