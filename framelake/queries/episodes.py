"""Queries of numbering, tasks, statistics and files, over the test tables.

An episode is a user of ``events``, in the order of (ts, event_id), with the
event type as task; a label of ``embeddings``; or an episode of ``frames``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import scalars as S
from ..operators import indexing as X
from ..operators import rotation as R
from ..operators import stats as A
from ..operators import tasks as T
from .base import table

FPS = 10
OFF_TIES = 3.3e-8
ORDER = ("ts", "event_id")
STAT_COLUMNS = ("min", "max", "mean", "std", *S.QUANTILE_NAMES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, without a negative zero, to compare results; the means of
    decimal data are often half-way, so they are shifted off before rounding."""
    return df.select(*[(F.round(F.col(f.name) + F.lit(OFF_TIES), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema])


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    numbers = X.dense_index(events, "user_id", "episode_index")
    return X.frame_index(events.join(X.small(numbers), "user_id"), "episode_index", ORDER)


def event_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.episode_stats(event_frames(spark, d), {"value": 0})


def episode_stats_events(spark: SparkSession, d: str) -> DataFrame:
    frames = event_frames(spark, d)
    stats = A.episode_stats(frames, {"value": 0}).drop("feature", "dim", "count")
    return rounded(X.episode_ranges(frames).join(stats, "episode_index"))


def episode_vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.episode_stats(table(spark, d, "embeddings"), {"embedding": 1}, "label"), 5)


def episode_stats_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every feature of every recorded episode, each frame once."""
    cols = ["index", "episode_index", "observation.state", "action", "observation.effort"]
    frames = table(spark, d, "frames").select(*[F.col(f"`{c}`") for c in cols]).distinct().where(F.col("episode_index").isNotNull())
    return rounded(A.episode_stats(frames, {"observation.state": 1, "action": 1, "observation.effort": 0}))


def dataset_stats_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.dataset_stats(event_stats(spark, d)))


def dataset_stats_frames(spark: SparkSession, d: str) -> DataFrame:
    """Dataset statistics from the stored ones of the episodes."""
    return rounded(A.dataset_stats(table(spark, d, "episode_stats").distinct()))


def frame_index_timestamp(spark: SparkSession, d: str) -> DataFrame:
    frames = X.with_timestamp(event_frames(spark, d), FPS)
    return frames.select("event_id", "episode_index", "frame_index", F.round(F.col("timestamp").cast("double"), 4).alias("timestamp"))


def global_index_ranges(spark: SparkSession, d: str) -> DataFrame:
    frames = event_frames(spark, d)
    return X.global_index(frames, X.episode_ranges(frames)).select("event_id", "episode_index", "index")


def task_dictionary_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return T.task_dictionary(T.episode_tasks(event_frames(spark, d), "event_type"))


def task_encode(spark: SparkSession, d: str) -> DataFrame:
    frames = event_frames(spark, d)
    return T.encode_tasks(frames, T.task_dictionary(T.episode_tasks(frames, "event_type")), "event_type").select("event_id", "task_index")


def task_remap_local(spark: SparkSession, d: str) -> DataFrame:
    """Numbers local to an episode, turned to those of the dictionary."""
    frames = event_frames(spark, d)
    per = T.episode_tasks(frames, "event_type")
    local = frames.join(per.withColumnRenamed("task", "event_type"), ["episode_index", "event_type"]).withColumnRenamed("local_index", "task_index")
    return T.remap_local(local.select("event_id", "episode_index", "task_index"), per, T.task_dictionary(per)).select("event_id", "task_index")


def merge_two_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Events of even and of odd users as two datasets, united."""
    events = table(spark, d, "events")
    frames, dictionaries, shift_episodes, shift_index = [], [], 0, 0
    for source in (0, 1):
        mine = events.where(F.pmod("user_id", F.lit(2)) == source)
        f = X.frame_index(mine.join(X.small(X.dense_index(mine, "user_id", "episode_index")), "user_id"), "episode_index", ORDER)
        f = X.global_index(f, X.episode_ranges(f))
        per = T.episode_tasks(f, "event_type")
        dictionary = T.task_dictionary(per)
        f = T.encode_tasks(f, dictionary, "event_type").select("event_id", F.lit(source).alias("source"), (F.col("episode_index") + shift_episodes).alias("episode_index"), (F.col("index") + shift_index).alias("index"), "task_index")
        frames.append(f)
        dictionaries.append(dictionary.withColumn("source", F.lit(source)))
        totals = mine.agg(F.countDistinct("user_id"), F.count(F.lit(1))).first()
        shift_episodes, shift_index = shift_episodes + totals[0], shift_index + totals[1]
    sources = dictionaries[0].unionByName(dictionaries[1])
    return T.remap_sources(frames[0].unionByName(frames[1]), sources, T.union_dictionary(sources)).select("event_id", "source", "episode_index", "index", "task_index")


def file_rotation_data(spark: SparkSession, d: str) -> DataFrame:
    """Files of at most 200 frames, closed before and after."""
    lengths = event_frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return R.places(R.rotate(lengths, ["episode_index"], "length", 200.0), 20)


def file_rotation_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Files by the estimated share of a source file, closed only before."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("episode_index")).agg(F.count(F.lit(1)).alias("length"))
    sized = lines.withColumn("mb", F.col("length") * F.lit(0.125))
    return R.rotate(sized, ["episode_index"], "mb", 400.0, after=False)


def file_rotation_media(spark: SparkSession, d: str) -> DataFrame:
    """Files and running times per camera (source) of documents as clips."""
    clips = table(spark, d, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("size"))
    clips = clips.withColumn("duration", F.col("size") / 8)
    filed = R.rotate(clips, ["doc_id"], "size", 20_000.0, group=["source"])
    return R.media_offsets(filed, ["source"], "doc_id", "duration")


def chunk_paths_v21(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("o_orderkey")
    path = L.path_column(L.DATA_PATH[L.V21], episode_chunk=L.chunk_of(e), episode_index=e)
    return table(spark, d, "orders").select(e.alias("episode_index"), path.alias("path"))


def chunk_paths_v30(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("o_orderkey")
    path = L.path_column(L.DATA_PATH[L.V30], chunk_index=L.chunk_of(e, 50), file_index=L.file_of(e, 50))
    return table(spark, d, "orders").select(e.alias("ordinal"), path.alias("path"))


def slice_by_index_range(spark: SparkSession, d: str) -> DataFrame:
    return X.check_slice(table(spark, d, "events"), 100, 250, "event_id").select("event_id", "user_id", "value")


def episode_slices(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the range that each recorded episode declares, and whether
    they are as many as its length."""
    episodes = table(spark, d, "episodes").select("episode_index", "length", "dataset_from_index", "dataset_to_index").distinct()
    frames = table(spark, d, "frames").select("index", "episode_index").distinct()
    have = frames.where(F.col("episode_index").isNotNull()).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    joined = episodes.join(have, "episode_index", "left")
    n = F.coalesce("n", F.lit(0)).alias("n_rows")
    whole = F.coalesce((F.col("n") == F.col("length")) & (F.col("lo") == F.col("dataset_from_index")) & (F.col("hi") == F.col("dataset_to_index") - 1), F.lit(False))
    return joined.select("episode_index", "length", n, whole.alias("whole"))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    frames = event_frames(spark, d)
    return X.with_timestamp(X.global_index(frames, X.episode_ranges(frames)), FPS)


def validate_contiguity(spark: SparkSession, d: str) -> DataFrame:
    """Events with a gap put in every seventh episode."""
    gap = F.when((F.col("episode_index") % 7 == 3) & (F.col("frame_index") >= 5), 1).otherwise(0)
    return X.contiguity(_indexed(spark, d).withColumn("index", F.col("index") + gap))


def validate_episode_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ranges with a shifted episode, a wrong length and one stored twice."""
    ranges = X.episode_ranges(event_frames(spark, d))
    e = F.col("episode_index")
    bad = ranges.withColumn("dataset_from_index", F.col("dataset_from_index") + F.when(e % 5 == 2, 1).otherwise(0)).withColumn("length", F.col("length") + F.when(e % 11 == 4, 1).otherwise(0))
    return X.chain_errors(bad.unionByName(bad.where(e == 6)))


def validate_timestamp_step(spark: SparkSession, d: str) -> DataFrame:
    late = F.when((F.col("episode_index") % 3 == 1) & (F.col("frame_index") == 4), 0.05).otherwise(0.0)
    moved = _indexed(spark, d).withColumn("timestamp", F.col("timestamp") + late)
    return rounded(X.timestamp_steps(moved, FPS), 3)


def validate_task_gaps(spark: SparkSession, d: str) -> DataFrame:
    """First number that no recorded task has, without every ninth of them."""
    tasks = table(spark, d, "tasks").select("task_index")
    return T.first_task_gap(tasks.where(F.col("task_index") % 9 != 8), tasks.count())


def duplicate_episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").groupBy("episode_index").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Declared features that have no stored statistics of an episode."""
    wanted = F.explode(F.array(*[F.lit(f) for f in ("observation.state", "action", "observation.effort")]))
    episodes = table(spark, d, "episodes").where(F.col("deleted_at").isNull()).select("episode_index").distinct().select("episode_index", wanted.alias("feature"))
    have = table(spark, d, "episode_stats").select("episode_index", "feature").distinct()
    return episodes.join(have, ["episode_index", "feature"], "left_anti")


def stats_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Stored statistics, overlaid by new ones of two features of all frames;
    some episodes and features have only the one or the other."""
    stored = table(spark, d, "episode_stats").distinct()
    cols = ["index", "episode_index", "observation.effort", "action"]
    frames = table(spark, d, "frames").where(F.col("episode_index").isNotNull()).select(*[F.col(f"`{c}`") for c in cols]).distinct()
    fresh = A.episode_stats(frames, {"observation.effort": 0, "action": 1})
    return rounded(A.overlay(stored, fresh).select("episode_index", "feature", "dim", "count", "min", "max", "mean"), 5)


def flatten_unflatten_stats(spark: SparkSession, d: str) -> DataFrame:
    """Long statistics to columns and back."""
    long = A.dataset_stats(table(spark, d, "episode_stats").distinct(), ("episode_index", "feature", "dim"))
    wide = A.flatten_stats(long, ["observation.state", "action", "observation.effort"])
    return rounded(A.unflatten_stats(wide).select("episode_index", "feature", "dim", "min", "max", "mean"))


def sanitize_nonfinite(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "frames").select("index", "repo_id", "`observation.effort`").distinct()
    x = S.finite(F.col("`observation.effort`"))
    found = frames.groupBy("repo_id").agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"))
    return rounded(found, 5)


def sample_indices(spark: SparkSession, d: str) -> DataFrame:
    """Frames to sample of each recorded episode."""
    lengths = table(spark, d, "episodes").groupBy("episode_index").agg(F.max("length").alias("n"))
    return lengths.select("episode_index", F.explode(S.sample_indices(F.coalesce("n", F.lit(0)))).alias("frame_index"))


def pixel_histogram_stats(spark: SparkSession, d: str) -> DataFrame:
    """Byte statistics per channel from histograms of order numbers."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("feature"), (F.col("o_orderkey") % 3).cast("int").alias("dim"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 256).cast("int").alias("bin"))
    hist = o.groupBy("feature", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    return rounded(A.histogram_stats(hist, ["feature", "dim"]))


def rate_and_pixel_format(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    rate = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, "0/0").when(F.col("p_partkey") % 5 == 2, F.col("p_size").cast("string")).otherwise(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001")))
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("yuv420p", "rgb24", "rgba", "gray16le", "yuva420p", "nv12")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    key = F.concat_ws(".", "p_type", F.lit("cam-"), F.col("p_size").cast("string"))
    return n.select("p_partkey", S.frame_rate(rate).alias("fps"), S.pixel_channels(fmt).alias("channels"), S.safe_key(key).alias("key"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", v.alias("k"))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """Features of each repo whose dtype differs from the first repo's."""
    info = table(spark, d, "dataset_info")
    specs = info.select("repo_id", F.explode(F.from_json("features", "map<string, struct<dtype: string>>")).alias("feature", "s")).select("repo_id", "feature", F.col("s.dtype").alias("dtype"))
    first = info.agg(F.min("repo_id").alias("first"))
    base = specs.join(F.broadcast(first), F.col("repo_id") == F.col("first")).select("feature", F.col("dtype").alias("left"))
    pairs = base.agg(F.collect_list(F.struct("feature", "left")).alias("all")).first()["all"]  # features of one repo
    declared = F.array(*[F.struct(F.lit(p["feature"]).alias("feature"), F.lit(p["left"]).alias("left")) for p in pairs])
    wanted = info.select("repo_id").distinct().select("repo_id", F.inline(declared))
    both = wanted.join(specs.withColumnRenamed("dtype", "right"), ["repo_id", "feature"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def version_aliases(spark: SparkSession, d: str) -> DataFrame:
    v = F.lower(F.trim("codebase_version"))
    pairs = [x for k, t in L.ALIASES.items() for x in (F.lit(k), F.lit(t))]
    return table(spark, d, "dataset_info").select("repo_id", F.create_map(*pairs)[v].alias("version"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each repo from its episodes that are not deleted."""
    e = table(spark, d, "episodes").where(F.col("deleted_at").isNull()).distinct()
    per = e.groupBy("repo_id").agg(F.countDistinct("episode_index").alias("total_episodes"), F.sum("length").alias("total_frames"), (F.max("`data/chunk_index`") + 1).alias("total_chunks"))
    n_tasks = e.select("repo_id", F.explode("tasks").alias("t")).groupBy("repo_id").agg(F.countDistinct("t").alias("total_tasks"))
    return per.join(n_tasks, "repo_id", "left")


_E = """
WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS episode_index FROM (SELECT DISTINCT user_id FROM events)),
f AS (SELECT e.*, episode_index, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events e JOIN u ON e.user_id = u.user_id),
l AS (SELECT episode_index, count(*) AS length FROM f GROUP BY 1),
r AS (SELECT episode_index, length, CAST(sum(length) OVER (ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index, CAST(sum(length) OVER (ORDER BY episode_index) AS BIGINT) AS dataset_to_index FROM l),
x AS (SELECT f.*, dataset_from_index + frame_index AS "index", CAST(CAST(frame_index AS FLOAT) / CAST(10 AS FLOAT) AS FLOAT) AS "timestamp" FROM f JOIN r ON f.episode_index = r.episode_index),
p AS (SELECT episode_index, coalesce(event_type, '') AS task, min(frame_index) AS seen FROM f GROUP BY 1, 2),
q AS (SELECT episode_index, task, row_number() OVER (PARTITION BY episode_index ORDER BY seen, task) - 1 AS local_index FROM p),
t AS (SELECT row_number() OVER (ORDER BY e1, l1) - 1 AS task_index, task FROM (SELECT task, min(episode_index) AS e1, arg_min(local_index, episode_index) AS l1 FROM q GROUP BY task))
"""


def _summary(x: str, digits: int = 6) -> str:
    qs = ", ".join(f"round(3.3e-8 + quantile_cont({x}, {q}), {digits}) + 0.0 AS {n}" for q, n in zip(S.QUANTILES, S.QUANTILE_NAMES))
    return f"round(3.3e-8 + min({x}), {digits}) + 0.0 AS \"min\", round(3.3e-8 + max({x}), {digits}) + 0.0 AS \"max\", round(3.3e-8 + avg({x}), {digits}) + 0.0 AS mean, round(3.3e-8 + sqrt(greatest(avg({x} * {x}) - avg({x}) * avg({x}), 0)), {digits}) + 0.0 AS std, {qs}"


def _weighted(source: str, groups: str) -> str:
    c = 'CAST(coalesce("count", 0) AS DOUBLE)'
    qs = ", ".join(f"round(3.3e-8 + coalesce(sum(coalesce({n}, mean) * {c}) / sum({c}), 0), 6) + 0.0 AS {n}" for n in S.QUANTILE_NAMES)
    m = f"(sum(mean * {c}) / sum({c}))"
    return f"SELECT {groups}, CAST(sum({c}) AS BIGINT) AS \"count\", round(3.3e-8 + min(\"min\"), 6) + 0.0 AS \"min\", round(3.3e-8 + max(\"max\"), 6) + 0.0 AS \"max\", round(3.3e-8 + {m}, 6) + 0.0 AS mean, round(3.3e-8 + sqrt(greatest(sum((std * std + mean * mean) * {c}) / sum({c}) - {m} * {m}, 0)), 6) + 0.0 AS std, {qs} FROM {source} GROUP BY {groups}"


_FRAMES = """
WITH f AS (SELECT DISTINCT "index" AS i, episode_index, "observation.state" AS s, action AS a, "observation.effort" AS e FROM frames WHERE episode_index IS NOT NULL),
w AS (SELECT episode_index, 'observation.state' AS feature, g AS dim, CAST(s[g + 1] AS DOUBLE) AS x FROM f, (SELECT unnest(range(0, 64)) AS g) WHERE g < len(s)
UNION ALL SELECT episode_index, 'action', g, CAST(a[g + 1] AS DOUBLE) FROM f, (SELECT unnest(range(0, 64)) AS g) WHERE g < len(a)
UNION ALL SELECT episode_index, 'observation.effort', 0, e FROM f),
v AS (SELECT episode_index, feature, CAST(dim AS INT) AS dim, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS x FROM w WHERE x IS NOT NULL)
"""


def _fold(source: str, size: str, limit: float, after: bool, group: str = "") -> str:
    """Recursive twin of the rotation; ``source`` has rn from 1 in its group."""
    full = f"(f.held > 0 AND f.used + {size} >= {limit})"
    g, on = (f"{group}, ", f" AND n.{group} = f.{group}") if group else ("", "")
    nxt = size.replace("n.", "")
    closes = lambda used: f"CASE WHEN {used} >= {limit} THEN 1 ELSE 0 END" if after else "0"
    return f"""
fold AS (SELECT {g}rn, 0 AS file, CAST({nxt} AS DOUBLE) AS used0, CAST(CASE WHEN {closes(nxt)} = 1 THEN 0 ELSE {nxt} END AS DOUBLE) AS used, CASE WHEN {closes(nxt)} = 1 THEN 0 ELSE 1 END AS held, {closes(nxt)} AS nextfile FROM {source} WHERE rn = 1
UNION ALL
SELECT {"n." + group + ", " if group else ""}n.rn, f.nextfile + CASE WHEN {full} THEN 1 ELSE 0 END,
 CAST(CASE WHEN {full} THEN {size} ELSE f.used + {size} END AS DOUBLE),
 CAST(CASE WHEN {closes(f"(CASE WHEN {full} THEN {size} ELSE f.used + {size} END)")} = 1 THEN 0 WHEN {full} THEN {size} ELSE f.used + {size} END AS DOUBLE),
 CASE WHEN {closes(f"(CASE WHEN {full} THEN {size} ELSE f.used + {size} END)")} = 1 THEN 0 WHEN {full} THEN 1 ELSE f.held + 1 END,
 f.nextfile + CASE WHEN {full} THEN 1 ELSE 0 END + {closes(f"(CASE WHEN {full} THEN {size} ELSE f.used + {size} END)")}
FROM fold f JOIN {source} n ON n.rn = f.rn + 1{on})"""


_REC = _E.replace("\nWITH u", "\nWITH RECURSIVE u")

QUERIES = {q.__name__: q for q in (
    episode_stats_events, episode_vector_stats, episode_stats_frames, dataset_stats_events, dataset_stats_frames, frame_index_timestamp,
    global_index_ranges, task_dictionary_first_seen, task_encode, task_remap_local, merge_two_datasets, file_rotation_data, file_rotation_estimated,
    file_rotation_media, chunk_paths_v21, chunk_paths_v30, slice_by_index_range, episode_slices, validate_contiguity, validate_episode_chain,
    validate_timestamp_step, validate_task_gaps, duplicate_episodes, missing_stats, stats_overlay, flatten_unflatten_stats, sanitize_nonfinite,
    sample_indices, pixel_histogram_stats, rate_and_pixel_format, json_props, schema_diff, version_aliases, totals,
)}

SQL = {
    "episode_stats_events": _E + f"SELECT r.episode_index, length, dataset_from_index, dataset_to_index, {_summary('value')} FROM f JOIN r ON f.episode_index = r.episode_index GROUP BY 1, 2, 3, 4",
    "episode_vector_stats": f"SELECT label, 'embedding' AS feature, dim, count(x) AS \"count\", {_summary('x', 5)} FROM (SELECT label, CAST(g AS INT) AS dim, CAST(embedding[g + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 2048)) AS g) WHERE g < len(embedding)) GROUP BY 1, 2, 3",
    "episode_stats_frames": _FRAMES + f"SELECT episode_index, feature, dim, count(x) AS \"count\", {_summary('x')} FROM v GROUP BY 1, 2, 3",
    "dataset_stats_events": _E + ", s AS (SELECT episode_index, 'value' AS feature, 0 AS dim, count(value) AS \"count\", min(value) AS \"min\", max(value) AS \"max\", avg(value) AS mean, sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)) AS std, " + ", ".join(f"quantile_cont(value, {q}) AS {n}" for q, n in zip(S.QUANTILES, S.QUANTILE_NAMES)) + " FROM f GROUP BY 1) " + _weighted("s", "feature, dim"),
    "dataset_stats_frames": _weighted("(SELECT DISTINCT * FROM episode_stats)", "feature, dim"),
    "frame_index_timestamp": _E + 'SELECT event_id, episode_index, frame_index, round(CAST("timestamp" AS DOUBLE), 4) AS "timestamp" FROM x',
    "global_index_ranges": _E + 'SELECT event_id, episode_index, "index" FROM x',
    "task_dictionary_first_seen": _E + "SELECT task_index, task FROM t",
    "task_encode": _E + "SELECT event_id, task_index FROM f JOIN t ON coalesce(event_type, '') = task",
    "task_remap_local": _E + "SELECT event_id, task_index FROM f JOIN t ON coalesce(event_type, '') = task",
    "merge_two_datasets": """
WITH e AS (SELECT *, CAST(user_id % 2 AS INT) AS source FROM events),
u AS (SELECT source, user_id, row_number() OVER (ORDER BY source, user_id) - 1 AS episode_index FROM (SELECT DISTINCT source, user_id FROM e)),
f AS (SELECT e.*, episode_index, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS frame_index FROM e JOIN u ON e.user_id = u.user_id),
x AS (SELECT *, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS "index" FROM f),
d AS (SELECT source, event_type AS task, min("index") AS seen FROM x GROUP BY 1, 2),
t AS (SELECT task, row_number() OVER (ORDER BY s, i) - 1 AS task_index FROM (SELECT task, min(source) AS s, arg_min(seen, source) AS i FROM d GROUP BY 1))
SELECT event_id, source, episode_index, "index", task_index FROM x JOIN t ON event_type = task""",
    "file_rotation_data": _REC + ", n0 AS (SELECT episode_index, length, episode_index + 1 AS rn FROM l)," + _fold("n0", "n.length", 200, True) + " SELECT n0.episode_index, length, CAST(file AS BIGINT) AS file, CAST(file // 20 AS BIGINT) AS chunk_index, CAST(file % 20 AS BIGINT) AS file_index FROM n0 JOIN fold ON n0.rn = fold.rn",
    "file_rotation_estimated": "WITH RECURSIVE n0 AS (SELECT l_suppkey AS episode_index, count(*) AS length, count(*) * 0.125 AS mb, row_number() OVER (ORDER BY l_suppkey) AS rn FROM lineitem GROUP BY 1)," + _fold("n0", "n.mb", 400, False) + " SELECT n0.episode_index, length, CAST(mb AS DOUBLE) AS mb, CAST(file AS BIGINT) AS file FROM n0 JOIN fold ON n0.rn = fold.rn",
    "file_rotation_media": "WITH RECURSIVE n0 AS (SELECT source, doc_id, CAST(coalesce(length(text), 0) AS DOUBLE) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)," + _fold("n0", "n.size", 20000, True, "source") + ", m AS (SELECT n0.source, doc_id, size, size / 8 AS duration, CAST(file AS BIGINT) AS file FROM n0 JOIN fold ON n0.rn = fold.rn AND n0.source = fold.source) SELECT *, sum(duration) OVER (PARTITION BY source, file ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS to_timestamp, sum(duration) OVER (PARTITION BY source, file ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - duration AS from_timestamp FROM m",
    "chunk_paths_v21": "SELECT o_orderkey AS episode_index, format('data/chunk-{:03d}/episode_{:06d}.parquet', o_orderkey // 1000, o_orderkey) AS path FROM orders",
    "chunk_paths_v30": "SELECT o_orderkey AS ordinal, format('data/chunk-{:03d}/file-{:03d}.parquet', o_orderkey // 50, o_orderkey % 50) AS path FROM orders",
    "slice_by_index_range": "SELECT event_id, user_id, value FROM events WHERE event_id >= 100 AND event_id < 250",
    "episode_slices": """WITH f AS (SELECT DISTINCT "index" AS i, episode_index FROM frames), h AS (SELECT episode_index, count(*) AS n, min(i) AS lo, max(i) AS hi FROM f WHERE episode_index IS NOT NULL GROUP BY 1)
SELECT e.episode_index, e.length, coalesce(n, 0) AS n_rows, coalesce(n = e.length AND lo = dataset_from_index AND hi = dataset_to_index - 1, false) AS whole FROM (SELECT DISTINCT episode_index, length, dataset_from_index, dataset_to_index FROM episodes) e LEFT JOIN h ON e.episode_index = h.episode_index""",
    "validate_contiguity": _E + """, y AS (SELECT episode_index, "index" + CASE WHEN episode_index % 7 = 3 AND frame_index >= 5 THEN 1 ELSE 0 END AS i FROM x),
z AS (SELECT episode_index, min(i) AS first_index, max(i) AS last_index, count(*) AS n_rows, count(DISTINCT i) AS nd FROM y GROUP BY 1)
SELECT episode_index, first_index, last_index, n_rows, (last_index - first_index + 1 = n_rows AND nd = n_rows) AS contiguous, first_index = sum(n_rows) OVER (ORDER BY episode_index) - n_rows AS starts_right FROM z""",
    "validate_episode_chain": _E + """, b AS (SELECT episode_index, length + CASE WHEN episode_index % 11 = 4 THEN 1 ELSE 0 END AS length, dataset_from_index + CASE WHEN episode_index % 5 = 2 THEN 1 ELSE 0 END AS a, dataset_to_index AS z FROM r),
c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE episode_index = 6),
k AS (SELECT *, lag(z, 1, 0) OVER (ORDER BY episode_index, a, z) AS prev, count(*) OVER (PARTITION BY episode_index) > 1 AS duplicate FROM c)
SELECT episode_index, a <> prev AS broken_chain, z - a <> length AS wrong_length, duplicate FROM k WHERE a <> prev OR z - a <> length OR duplicate""",
    "validate_timestamp_step": _E + """, y AS (SELECT episode_index, "index", CAST("timestamp" AS DOUBLE) + CASE WHEN episode_index % 3 = 1 AND frame_index = 4 THEN 0.05 ELSE 0 END AS t FROM x),
z AS (SELECT *, t - lag(t) OVER (PARTITION BY episode_index ORDER BY "index") AS delta FROM y)
SELECT episode_index, min("index") AS "index", round(3.3e-8 + arg_min(delta, "index"), 3) + 0.0 AS delta FROM z WHERE abs(delta - 0.1) > 1e-3 AND abs(delta) > 1e-3 GROUP BY 1""",
    "validate_task_gaps": "SELECT min(i) AS task_index FROM (SELECT unnest(range(0, (SELECT count(*) FROM tasks))) AS i) WHERE i NOT IN (SELECT task_index FROM tasks WHERE task_index % 9 <> 8) HAVING min(i) IS NOT NULL",
    "duplicate_episodes": "SELECT episode_index, count(*) AS n FROM episodes GROUP BY 1 HAVING count(*) > 1",
    "missing_stats": "SELECT * FROM (SELECT DISTINCT episode_index, feature FROM episodes, (SELECT unnest(['observation.state', 'action', 'observation.effort']) AS feature) WHERE deleted_at IS NULL) EXCEPT SELECT episode_index, feature FROM episode_stats",
    "stats_overlay": _FRAMES + """, n AS (SELECT episode_index, feature, dim, count(x) AS "count", min(x) AS "min", max(x) AS "max", avg(x) AS mean FROM v WHERE feature IN ('observation.effort', 'action') GROUP BY 1, 2, 3),
o AS (SELECT DISTINCT * FROM episode_stats)
SELECT episode_index, feature, dim, "count", round(3.3e-8 + "min", 5) + 0.0 AS "min", round(3.3e-8 + "max", 5) + 0.0 AS "max", round(3.3e-8 + mean, 5) + 0.0 AS mean FROM (SELECT episode_index, feature, dim, "count", "min", "max", mean FROM n UNION ALL SELECT episode_index, feature, dim, "count", "min", "max", mean FROM o WHERE (episode_index, feature) NOT IN (SELECT (episode_index, feature) FROM n))""",
    "flatten_unflatten_stats": 'SELECT episode_index, feature, dim, round(3.3e-8 + min("min"), 6) + 0.0 AS "min", round(3.3e-8 + max("max"), 6) + 0.0 AS "max", round(3.3e-8 + sum(mean * "count") / sum("count"), 6) + 0.0 AS mean FROM (SELECT DISTINCT * FROM episode_stats) GROUP BY 1, 2, 3',
    "sanitize_nonfinite": 'WITH f AS (SELECT DISTINCT "index" AS i, repo_id, "observation.effort" AS e FROM frames), g AS (SELECT repo_id, CASE WHEN isnan(e) OR isinf(e) THEN 0 ELSE e END AS x FROM f) SELECT repo_id, count(x) AS n, round(3.3e-8 + min(x), 5) + 0.0 AS lo, round(3.3e-8 + max(x), 5) + 0.0 AS hi, round(3.3e-8 + avg(x), 5) + 0.0 AS mean FROM g GROUP BY 1',
    "sample_indices": """WITH n AS (SELECT episode_index, coalesce(max(length), 0) AS n FROM episodes GROUP BY 1), k AS (SELECT *, CAST(least(greatest(floor(pow(n, 0.75)), least(100, n)), 10000) AS BIGINT) AS k FROM n WHERE n > 0)
SELECT episode_index, CASE WHEN k <= 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (k - 1) + 0.5) AS BIGINT) END AS frame_index FROM k, (SELECT unnest(range(0, 10000)) AS i) WHERE i < k""",
    "pixel_histogram_stats": f"WITH b AS (SELECT o_orderpriority AS feature, CAST(o_orderkey % 3 AS INT) AS dim, ((o_custkey * 7 + o_orderkey) % 256) / 255.0 AS x FROM orders) SELECT feature, dim, count(x) AS \"count\", {_summary('x')} FROM b GROUP BY 1, 2",
    "rate_and_pixel_format": """SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN p_size ELSE floor(p_size * 1000 / 1001 + 0.5) END AS DOUBLE) AS fps, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 4 END AS channels, regexp_replace(p_type || '.cam-.' || p_size, '[^A-Za-z0-9]', '_', 'g') AS "key" FROM part""",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "schema_diff": """WITH k AS (SELECT repo_id, features, unnest(json_keys(features)) AS feature FROM dataset_info), s AS (SELECT repo_id, feature, json_extract_string(features, '$."' || feature || '".dtype') AS dtype FROM k),
b AS (SELECT feature, dtype AS "left" FROM s WHERE repo_id = (SELECT min(repo_id) FROM dataset_info)), w AS (SELECT DISTINCT i.repo_id, b.* FROM dataset_info i, b)
SELECT coalesce(w.repo_id, s.repo_id) AS repo_id, coalesce(w.feature, s.feature) AS feature, w."left", s.dtype AS "right" FROM w FULL JOIN s ON w.repo_id = s.repo_id AND w.feature = s.feature WHERE w."left" IS DISTINCT FROM s.dtype""",
    "version_aliases": "SELECT repo_id, CASE lower(trim(codebase_version)) WHEN 'v2.1' THEN 'v2.1' WHEN 'v2' THEN 'v2.1' WHEN '2.1' THEN 'v2.1' WHEN 'v3.0' THEN 'v3.0' WHEN 'v3' THEN 'v3.0' WHEN '3.0' THEN 'v3.0' END AS version FROM dataset_info",
    "totals": """WITH e AS (SELECT DISTINCT * FROM episodes WHERE deleted_at IS NULL), p AS (SELECT repo_id, count(DISTINCT episode_index) AS total_episodes, CAST(sum(length) AS BIGINT) AS total_frames, max("data/chunk_index") + 1 AS total_chunks FROM e GROUP BY 1),
t AS (SELECT repo_id, count(DISTINCT t) AS total_tasks FROM (SELECT repo_id, unnest(tasks) AS t FROM e) GROUP BY 1) SELECT p.*, total_tasks FROM p LEFT JOIN t ON p.repo_id = t.repo_id""",
}
