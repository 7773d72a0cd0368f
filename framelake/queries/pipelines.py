"""Queries that run whole pipelines: build, write, read, convert, validate."""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import FeatureSpec
from ..operators.common import checkpoint_dir
from ..plans import build as B
from ..plans import validate as V
from ..sources.dataset import Dataset, read_dataset
from ..sources.files import footers, listing, local
from ..streaming import flush
from . import episodes as E
from .base import table

FEATURES = {"value": FeatureSpec("float64", (1,)), "kind": FeatureSpec("string", (1,))}


def _place(spark: SparkSession, name: str) -> str:
    return os.path.join(local(checkpoint_dir(spark)), f"{name}-{uuid.uuid4().hex}")


def _built(spark: SparkSession, d: str, version: str) -> Dataset:
    events = table(spark, d, "events").withColumn("kind", F.col("event_type"))
    steps = events.select("user_id", "ts", "event_id", "event_type", "value", "kind")
    return B.build(steps, FEATURES, E.FPS, episode="user_id", order=["ts", "event_id"], task="event_type", version=version)


def finalize_and_validate(spark: SparkSession, d: str) -> DataFrame:
    """Events written as a dataset of each layout; the reports of both."""
    rows = []
    for version in ("v2.1", "v3.0"):
        root = _place(spark, "dataset")
        B.save(_built(spark, d, version), root)
        report = V.validate(spark, root, strict=True)
        rows.append((version, report.ok, report.count(V.ERROR), report.count(V.WARNING), report.summary))
    return spark.createDataFrame(rows, "version string, ok boolean, errors int, warnings int, summary string")


def convert_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Frames after v3.0, to v2.1, to v3.0 again, all through files."""
    roots = [_place(spark, "dataset") for _ in range(3)]
    B.save(_built(spark, d, "v3.0"), roots[0])
    B.save(B.convert(read_dataset(spark, roots[0]), "v2.1"), roots[1])
    B.save(B.convert(read_dataset(spark, roots[1]), "v3.0"), roots[2])
    frames = read_dataset(spark, roots[2]).frames
    return frames.select("index", "episode_index", "frame_index", "task_index", "value", "kind")


def self_merge(spark: SparkSession, d: str) -> DataFrame:
    """A dataset united with itself: twice the frames, the same tasks."""
    made = _built(spark, d, "v3.0")
    united = B.union([made, made])
    per = united.frames.groupBy("task_index").agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct("episode_index").alias("n_episodes"), F.max("index").alias("last_index"))
    return per.join(united.tasks, "task_index").select("task_index", "task", "n_frames", "n_episodes", "last_index")


def streaming_flush(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive as a stream, numbered and appended to a table."""
    shape = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").schema
    out, log = _place(spark, "staged"), _place(spark, "stream")
    source = spark.readStream.schema(shape).parquet(glob.escape(local(d)) + "/event[s].parquet")
    named = flush.numbered(source, episode="user_id", order="ts", task="event_type", fps=E.FPS)
    query = flush.staged(named, out, log).trigger(availableNow=True).start()
    query.awaitTermination()
    staged = spark.read.parquet(out)
    return staged.select("event_id", "user_id", "frame_index", "local_task", F.round(F.col("timestamp").cast("double"), 4).alias("timestamp"))


def stream_to_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive as a stream, staged, made a dataset and validated."""
    shape = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").schema
    out, log, root = _place(spark, "staged"), _place(spark, "stream"), _place(spark, "dataset")
    source = spark.readStream.schema(shape).parquet(glob.escape(local(d)) + "/event[s].parquet")
    flush.staged(flush.numbered(source, episode="user_id", order="ts", task="event_type", fps=E.FPS), out, log).trigger(availableNow=True).start().awaitTermination()
    steps = spark.read.parquet(out).withColumn("kind", F.col("event_type")).select("user_id", "frame_index", "event_type", "value", "kind")
    B.save(B.build(steps, FEATURES, E.FPS, episode="user_id", order=["frame_index"], task="event_type", version="v3.0"), root)
    report = V.validate(spark, root, strict=True)
    return spark.createDataFrame([(report.version, report.ok, report.count(V.ERROR), report.count(V.WARNING), report.summary)], "version string, ok boolean, errors int, warnings int, summary string")


def faulty_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A dataset with faults put into every third, fifth and seventh episode and
    the number of each that validation counts."""
    made = _built(spark, d, "v3.0")
    e = F.col("episode_index")
    late = F.when((e % 3 == 0) & (F.col("frame_index") > 0), F.col("timestamp") + F.lit(0.5)).otherwise(F.col("timestamp"))
    frames = made.frames.withColumn("timestamp", late.cast("float"))
    episodes = made.episodes.withColumn("length", F.col("length") + (e % 5 == 0).cast("bigint"))
    episodes = episodes.withColumn("dataset_to_index", F.col("dataset_to_index") + (e % 7 == 0).cast("bigint"))
    tasks = made.tasks.withColumn("task_index", F.when(F.col("task_index") > 0, F.col("task_index") + 1).otherwise(F.col("task_index")))
    root = _place(spark, "dataset")
    B.save(replace(made, frames=frames, episodes=episodes, tasks=tasks), root)
    report = V.validate(spark, root, strict=True)
    return spark.createDataFrame([(s, c, n) for (s, c), n in sorted(report.counts.items())], "severity string, code string, n bigint")


def partial_stats(spark: SparkSession, d: str) -> DataFrame:
    """Moments of flushes of 25 frames, made one for each episode again."""
    parts = flush.flush_stats(E.event_frames(spark, d), "value", 25)
    whole = parts.groupBy("episode_index").agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("mean")
    )
    return E.rounded(whole)


def file_footers(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns' sizes of the test tables from their footers."""
    paths = sorted(p for t in ("lineitem", "orders", "events") for p in (glob.glob(f"{local(d)}/{t}.parquet/*.parquet") or [f"{local(d)}/{t}.parquet"]))
    found = footers(spark, paths)
    name = F.regexp_extract("path", r"(\w+)\.parquet", 1)
    return found.groupBy(name.alias("table_name")).agg(F.sum("n_rows").alias("n_rows"))


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of a written dataset and whether they are empty."""
    root = _place(spark, "dataset")
    B.save(_built(spark, d, "v3.0"), root)
    return listing(spark, root).select("path", (F.col("length") > 0).alias("filled"))


QUERIES = {q.__name__: q for q in (finalize_and_validate, convert_roundtrip, self_merge, stream_to_dataset, faulty_dataset, streaming_flush, partial_stats, file_footers, file_listing)}

_TOTAL = "(SELECT count(DISTINCT user_id) FROM events) || ' episodes, ' || (SELECT count(*) FROM events) || ' frames, ' || (SELECT count(DISTINCT event_type) FROM events) || ' tasks'"
SQL = {
    "finalize_and_validate": f"SELECT v AS version, true AS ok, 0 AS errors, 0 AS warnings, v || ': ' || {_TOTAL} AS summary FROM (SELECT unnest(['v2.1', 'v3.0']) AS v)",
    "faulty_dataset": """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), e AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS e, n FROM n),
c AS (SELECT 'error' AS severity, 'length' AS code, count(*) FILTER (e % 5 = 0) AS n FROM e
UNION ALL SELECT 'error', 'file_range', count(*) FILTER (e % 5 = 0) FROM e
UNION ALL SELECT 'error', 'total_frames', CAST(count(*) FILTER (e % 5 = 0) > 0 AS INT) FROM e
UNION ALL SELECT 'error', 'episode_chain', count(*) FILTER ((e % 7 = 0) <> (e % 5 = 0) OR (e > 0 AND (e - 1) % 7 = 0)) FROM e
UNION ALL SELECT 'error', 'task_gap', CAST(count(DISTINCT event_type) > 1 AS INT) FROM events
UNION ALL SELECT 'warning', 'timestamp_step', count(*) FILTER (e % 3 = 0 AND n > 1) FROM e)
SELECT severity, code, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""",
    "stream_to_dataset": f"SELECT 'v3.0' AS version, true AS ok, 0 AS errors, 0 AS warnings, 'v3.0: ' || {_TOTAL} AS summary",
    "convert_roundtrip": E._E + "SELECT \"index\", episode_index, frame_index, task_index, value, event_type AS kind FROM x JOIN t ON coalesce(event_type, '') = task",
    "self_merge": E._E + "SELECT task_index, task, 2 * count(*) AS n_frames, 2 * count(DISTINCT episode_index) AS n_episodes, max(\"index\") + (SELECT count(*) FROM events) AS last_index FROM x JOIN t ON coalesce(event_type, '') = task GROUP BY 1, 2",
    "streaming_flush": E._E + "SELECT event_id, user_id, frame_index, local_index AS local_task, round(CAST(\"timestamp\" AS DOUBLE), 4) AS \"timestamp\" FROM x JOIN q ON x.episode_index = q.episode_index AND coalesce(event_type, '') = q.task",
    "partial_stats": E._E + "SELECT episode_index, count(value) AS \"count\", round(3.3e-8 + min(value), 6) + 0.0 AS \"min\", round(3.3e-8 + max(value), 6) + 0.0 AS \"max\", round(3.3e-8 + avg(value), 6) + 0.0 AS mean FROM f GROUP BY 1",
    "file_footers": "SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events",
}
