"""Validation of a written dataset.

Every check is a small DataFrame of (severity, code, subject, message); the
report is their union.  Frames are read once for all checks of a kind, with
only the columns that are checked, and nothing larger than a row for each
problem reaches the driver.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import DEFAULT_FEATURES, data_columns, keys_of
from ..operators import indexing as X
from ..operators import tasks as T
from ..sources.dataset import data_files, load_info, read_dataset
from ..sources.files import listing, local

ERROR, WARNING = "error", "warning"
#: A check shows so many problems, errors first; the counts are of all.
SHOWN = 1000

Problem = tuple[str, str, str, str]


@dataclass
class Report:
    """``problems`` are those that are shown; ``counts`` has the number of all by
    severity and code, and only it decides whether the dataset is ok."""

    version: str = ""
    summary: str = ""
    problems: list[Problem] = field(default_factory=list)
    counts: Counter[tuple[str, str]] = field(default_factory=Counter)

    @property
    def errors(self) -> list[str]:
        return [m for s, _, _, m in self.problems if s == ERROR]

    @property
    def warnings(self) -> list[str]:
        return [m for s, _, _, m in self.problems if s == WARNING]

    def count(self, severity: str) -> int:
        return sum(n for (s, _), n in self.counts.items() if s == severity)

    @property
    def ok(self) -> bool:
        return not self.count(ERROR)

    def add(self, severity: str, code: str, subject: str, message: str) -> None:
        self.counts[severity, code] += 1
        self.problems.append((severity, code, subject, message))

    def add_all(self, found: Iterable[Problem]) -> None:
        """Counts all, shows the first of them, errors before warnings."""
        rows = sorted(found, key=lambda r: r[0])  # "error" is before "warning"
        self.counts.update((severity, code) for severity, code, _, _ in rows)
        self.problems += rows[:SHOWN]

    def add_rows(self, rows: DataFrame) -> None:
        """``add_all`` of a DataFrame: the counts are an aggregate, and only what
        is shown is fetched, by a second pass that a clean dataset is spared."""
        counts = {(r["severity"], r["code"]): r["count"] for r in rows.groupBy("severity", "code").count().collect()}
        self.counts.update(counts)
        if counts:
            self.problems += [tuple(r) for r in rows.orderBy("severity", "code", "subject", "message").limit(SHOWN).collect()]


def problems(rows: DataFrame, severity: str, code: str, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), message.alias("message"))


def frame_checks(frames: DataFrame, episodes: DataFrame, fps: int, strict: bool) -> DataFrame:
    """Contiguity, lengths and time steps of the frames of all episodes."""
    e = F.col("episode_index")
    runs = X.contiguity(frames)
    gaps = problems(runs.where(~F.col("contiguous")), ERROR, "index_gap", e, F.format_string("episode %d: index not contiguous", e))
    starts = problems(runs.where(~F.col("starts_right")), ERROR, "index_start", e, F.format_string("episode %d: index starts at %d", e, F.col("first_index")))
    both = runs.join(episodes.select("episode_index", "length"), "episode_index", "full")
    rows = F.coalesce(F.col("n_rows"), F.lit(0))
    wrong = both.where(rows != F.coalesce(F.col("length"), F.lit(-1)))
    out = gaps.unionByName(starts).unionByName(problems(wrong, ERROR, "length", e, F.format_string("episode %d: %d rows, length %d", e, rows, F.coalesce(F.col("length"), F.lit(-1)))))
    if strict:
        steps = X.timestamp_steps(frames, fps)
        out = out.unionByName(problems(steps, WARNING, "timestamp_step", e, F.format_string("episode %d: step %.6f at index %d", e, F.col("delta"), F.col("index"))))
    return out


def chain_checks(episodes: DataFrame) -> DataFrame:
    bad = X.chain_errors(episodes)
    e = F.col("episode_index")
    return problems(bad, ERROR, "episode_chain", e, F.format_string("episode %d: broken chain %s, wrong length %s, duplicate %s", e, F.col("broken_chain").cast("string"), F.col("wrong_length").cast("string"), F.col("duplicate").cast("string")))


def task_checks(dictionary: DataFrame, total: int) -> DataFrame:
    gap = T.first_task_gap(dictionary, total)
    return problems(gap, ERROR, "task_gap", F.col("task_index"), F.format_string("tasks: no task_index %d", F.col("task_index")))


def place_checks(frames: DataFrame, episodes: DataFrame, info: L.DatasetInfo) -> DataFrame:
    """v3.0: each episode's frames are in the file it names, in its range.

    ``frames`` has episode_index, index and path; episodes are joined by their
    number, and the range of indices is a filter, so one scan serves them all.
    """
    e = F.col("episode_index")
    path = L.path_column(info.data_path, chunk_index=F.col("`data/chunk_index`"), file_index=F.col("`data/file_index`"))
    wanted = episodes.select(e, path.alias("wanted"), F.col("dataset_from_index").alias("from"), F.col("dataset_to_index").alias("to"), "length")
    there = F.when((F.col("path") == F.col("wanted")) & (F.col("index") >= F.col("from")) & (F.col("index") < F.col("to")), 1)
    held = frames.join(X.small(wanted.drop("length")), "episode_index").groupBy("episode_index").agg(F.count(there).alias("n"))
    bad = wanted.join(held, "episode_index", "left").where(F.coalesce("n", F.lit(0)) != F.coalesce("length", F.lit(-1)))
    return problems(bad, ERROR, "file_range", e, F.format_string("episode %d: %d of %d frames in %s at their range", e, F.coalesce("n", F.lit(0)), F.coalesce("length", F.lit(-1)), "wanted"))


def file_checks(spark: SparkSession, root: str, info: L.DatasetInfo) -> tuple[DataFrame, DataFrame]:
    """Problems of the data files, and the paths that are there.

    v2.1 names one file for each episode; the names are made and compared with
    the listing in parallel.
    """
    there = listing(spark, f"{local(root).rstrip('/')}/data").select(F.concat(F.lit("data/"), "path").alias("path")).where(F.col("path").endswith(".parquet"))
    if L.parse_version(info.codebase_version) == L.V21:
        e = F.col("id")
        template = info.data_path if "{" in info.data_path else L.DATA_PATH[L.V21]
        wanted = spark.range(info.total_episodes).select(L.path_column(template, episode_chunk=L.chunk_of(e, info.chunks_size), episode_index=e).alias("path"))
        gone = wanted.join(there, "path", "left_anti")
        there = there.join(wanted, "path", "left_semi")
    else:
        there = there.where(F.col("path").rlike(r"^data/chunk-[^/]*/file-[^/]*\.parquet$"))
        gone = there.limit(0)
    return problems(gone, ERROR, "missing_file", F.col("path"), F.format_string("missing %s", "path")), there


def column_checks(spark: SparkSession, root: str, info: L.DatasetInfo, report: Report) -> None:
    """Columns that data files lack, from their footers in parallel."""
    from ..operators.drift import footer_fields

    missing, there = file_checks(spark, root, info)
    report.add_rows(missing)
    wanted = F.array(*[F.lit(c) for c in sorted({*data_columns(info.features), *DEFAULT_FEATURES})])
    base = local(root).rstrip("/")
    full = there.select(F.monotonically_increasing_id().alias("ordinal"), F.concat(F.lit(f"{base}/"), "path").alias("path"))
    have = footer_fields(full.repartition(spark.sparkContext.defaultParallelism)).groupBy("path").agg(F.collect_set("field").alias("have"))
    lacking = have.select(F.substring("path", len(base) + 2, 1 << 30).alias("path"), F.explode(F.array_except(wanted, "have")).alias("field"))
    report.add_rows(problems(lacking, ERROR, "missing_column", F.col("path"), F.format_string("%s: no column %s", "path", "field")))


def validate(spark: SparkSession, root: str, *, strict: bool = True) -> Report:
    """Checks a dataset of either layout; an unreadable one is not ok."""
    report = Report()
    base = local(root)
    add = report.add
    exists = lambda name: os.path.exists(os.path.join(base, name))
    try:
        info = load_info(root)
    except (OSError, ValueError, KeyError, TypeError) as e:
        add(ERROR, "info", L.INFO, f"{L.INFO}: {e}")
        return report
    if strict and not os.path.isdir(os.path.join(base, "data")):
        add(ERROR, "no_data", "data", "missing data/")
    try:
        version = report.version = L.parse_version(info.codebase_version)
    except ValueError as e:
        add(ERROR, "version", L.INFO, str(e))
        return report
    if version == L.V21:
        if not info.data_path.startswith("data/"):
            add(ERROR, "data_path", L.INFO, f"data_path {info.data_path}")
        needed = [L.INFO, L.OLD_EPISODES, L.OLD_TASKS, L.OLD_STATS]
        if strict and not exists(L.STATS):
            add(WARNING, "stats", L.STATS, f"missing {L.STATS}")
    else:
        if "file-{file_index" not in info.data_path:
            add(ERROR, "data_path", L.INFO, f"data_path {info.data_path}")
        needed = [L.INFO, L.STATS, L.TASKS, "meta/episodes"]
    for name in needed:
        if not exists(name):
            add(ERROR, "missing_file", name, f"missing {name}")
    media = keys_of(info.features, "image", "video")
    if exists(L.STATS) and media:
        import json

        with open(os.path.join(base, L.STATS)) as f:
            have = json.load(f)
        for k in media:
            if k not in have:
                add(ERROR, "stats_coverage", k, f"{L.STATS}: no statistics of {k}")
    if info.splits.get("train") != f"0:{info.total_episodes}":
        add(ERROR, "splits", L.INFO, f"splits.train is {info.splits.get('train')!r}")
    if os.path.isdir(os.path.join(base, "data")):
        column_checks(spark, root, info, report)
    elif info.total_episodes:
        add(ERROR, "missing_file", "data", "missing data/")
    if any(report.counts[ERROR, c] for c in ("missing_file", "missing_column")):
        return report
    d = read_dataset(spark, root)
    counts = d.episodes.agg(F.count(F.lit(1)), F.sum("length")).first()
    if counts[0] != info.total_episodes:
        add(ERROR, "total_episodes", "episodes", f"{counts[0]} episodes, total_episodes {info.total_episodes}")
    if (counts[1] or 0) != info.total_frames:
        add(ERROR, "total_frames", "episodes", f"lengths sum to {counts[1]}, total_frames {info.total_frames}")
    n_tasks, n_frames = d.tasks.count(), d.frames.count()
    if n_tasks != info.total_tasks:
        add(ERROR, "total_tasks", "tasks", f"{n_tasks} tasks, total_tasks {info.total_tasks}")
    if n_frames != info.total_frames:
        add(ERROR, "total_frames", "data", f"{n_frames} frames, total_frames {info.total_frames}")
    checks = frame_checks(d.frames, d.episodes, info.fps, strict).unionByName(chain_checks(d.episodes)).unionByName(task_checks(d.tasks, info.total_tasks))
    if version == L.V30:
        files = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
        located = files.select("episode_index", "index", F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[^/]+)$", 1).alias("path"))
        checks = checks.unionByName(place_checks(located, d.episodes, info))
    report.add_rows(checks)
    if version == L.V21:
        empty = d.episodes.join(d.stats.select("episode_index").distinct(), "episode_index", "left_anti")
        report.add_rows(problems(empty, WARNING, "empty_stats", F.col("episode_index"), F.format_string("episode %d: no statistics", "episode_index")))
    if strict and info.video_path:
        report.add_rows(video_checks(d.episodes, info, base))
    report.summary = f"{version}: {info.total_episodes} episodes, {info.total_frames} frames, {info.total_tasks} tasks"
    return report


def video_checks(episodes: DataFrame, info: L.DatasetInfo, base: str) -> DataFrame:
    """Videos that each episode and camera should have and that are absent or
    empty; in v3.0 a warning where the metadata names no file."""
    e = F.col("episode_index")
    wanted = episodes.select(F.lit(None).cast("bigint").alias("episode_index"), F.lit("").alias("camera"), F.lit("").alias("path")).limit(0)
    for key in keys_of(info.features, "video"):
        if L.parse_version(info.codebase_version) == L.V21:
            path = L.path_column(info.video_path, video_key=F.lit(key), episode_chunk=L.chunk_of(e, info.chunks_size), episode_index=e)
        else:
            at = [F.col(f"`{c}`").cast("bigint") if c in episodes.columns else F.lit(None).cast("bigint") for c in (f"videos/{key}/chunk_index", f"videos/{key}/file_index")]
            path = F.when((at[0] >= 0) & (at[1] >= 0), L.path_column(L.VIDEO_PATH[L.V30], video_key=F.lit(key), chunk_index=at[0], file_index=at[1]))
        wanted = wanted.unionByName(episodes.select(e, F.lit(key).alias("camera"), path.alias("path")))
    spark = episodes.sparkSession
    at = os.path.join(base, "videos")
    has = os.path.isdir(at) and any(names for _, _, names in os.walk(at))
    files = listing(spark, at).where(F.col("length") > 0).select(F.concat(F.lit("videos/"), "path").alias("path")) if has else spark.createDataFrame([], "path string")
    unnamed = problems(wanted.where(F.col("path").isNull()), WARNING, "video_meta", e, F.format_string("episode %d: no video metadata of %s", e, "camera"))
    gone = wanted.where(F.col("path").isNotNull()).join(files, "path", "left_anti")
    return unnamed.unionByName(problems(gone, ERROR, "video", F.col("path"), F.format_string("episode %d: missing or empty %s", e, "path")))


def file_diff(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Columns field, left, right of what differs between the data files of two
    datasets: their number, and each column's types in them."""
    from ..operators.drift import file_schemas

    def described(root: str, name: str) -> DataFrame:
        base = local(root)
        files = [os.path.join(base, f) for f in data_files(root, load_info(root)) if os.path.exists(os.path.join(base, f))]
        types = file_schemas(spark, files).groupBy(F.concat(F.lit("column."), "field").alias("field")).agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias(name))
        return types.unionByName(spark.createDataFrame([("files", str(len(files)))], f"field string, {name} string"))

    both = described(left, "left").join(described(right, "right"), "field", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).orderBy("field")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Columns path, length and digest of all files: what two runs that should
    give the same dataset are compared by.  Files are read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(local(root))
    base = os.path.abspath(local(root)).rstrip("/")
    return files.select(F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})").alias("path"), "length", F.sha2("content", 256).alias("digest"))


def schema_diff(spark: SparkSession, a: L.DatasetInfo, b: L.DatasetInfo) -> DataFrame:
    """Columns field, left, right of what differs between two datasets."""
    rows = lambda i: [("codebase_version", i.codebase_version), ("fps", str(i.fps)), *[(f"features.{k}", v.canonical()) for k, v in i.features.items()]]
    left, right = spark.createDataFrame(rows(a), "field string, left string"), spark.createDataFrame(rows(b), "field string, right string")
    return left.join(right, "field", "full").where(~F.col("left").eqNullSafe(F.col("right"))).orderBy("field")
