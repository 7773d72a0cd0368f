"""Queries over frames, episodes and tasks (problems 1, 2, 3 and 7)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_ROWS, checkpoint_dir
from ..queries.base import table
from ..sources.files import local
from . import formatting as D
from . import packing as K
from . import percentiles as P
from . import splits as S

FEATURES = {"observation.state": True, "action": True, "observation.effort": False}


def _frame_values(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Every value of every frame, each index once."""
    cols = [F.col(f"`{c}`") for c in ("index", *keep, *FEATURES)]
    rows = table(spark, d, "frames").select(*cols).distinct()
    keys = [F.col(f"`{k}`") for k in keep]
    return P.unpivot(rows, [*keys, F.col("index").alias("tie")], FEATURES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    values = _frame_values(spark, d, "episode_index").where(F.col("episode_index").isNotNull())
    names = list(FEATURES)
    place = F.coalesce(*[F.when(F.col("feature") == f, F.lit(i)) for i, f in enumerate(names)])
    stats = table(spark, d, "episode_stats").select(
        "episode_index", (F.shiftleft(place, 16) + F.col("dim")).cast("int").alias("series"), "q10", "q50", "q90"
    ).where(F.col("series").isNotNull())
    found = P.wrong_quantiles(stats, values, ["episode_index", "series"], "value", spread=F.col("tie"))
    return found.select("episode_index", *P.series_columns(names))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _frame_values(spark, d, "repo_id", "recorded_at").withColumn("day", F.to_date("recorded_at")).drop("recorded_at")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Exact q01 to q99 per repo, day, feature and dim."""
    found = P.percentiles(_daily(spark, d), ["repo_id", "day", "series"], "value", spread=F.col("tie"))
    qs = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in found.columns if c.startswith("q")]
    return found.select("repo_id", "day", *P.series_columns(list(FEATURES)), "n", *qs)


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all days of a repo, from the combinable daily form."""
    daily = P.digests(_daily(spark, d), ["repo_id", "day", "series"], "value", spread=F.col("tie"))
    found = P.combine_digests(daily, ["repo_id", "series"])
    return found.select("repo_id", *P.series_columns(list(FEATURES)), "n", *[c for c in found.columns if c.startswith("q")], "rank_error")


IDS = ("operator_id", "session_id", "scene_id")


def _in_batches(spark: SparkSession, d: str, by: str, n: int) -> DataFrame:
    """The component table after the episodes came in ``n`` batches, by equal
    ranges of a column; between them only the written tables are kept."""
    shares = S.shares_of(table(spark, d, "dataset_info"), "repo_id", "splits")
    episodes = table(spark, d, "episodes").where(F.col("episode_index").isNotNull()).withColumn("w", F.lit(1))
    at = F.unix_micros(F.col(by).cast("timestamp")) if by.endswith("_at") else F.col(by)
    lo, hi = episodes.agg(F.coalesce(F.min(at), F.lit(0)), F.coalesce(F.max(at), F.lit(0))).first()
    batch = F.coalesce(F.floor((at - lo) * F.lit(float(n)) / (hi - lo + 1)), F.lit(0))
    root = os.path.join(local(checkpoint_dir(spark)), f"splits-{uuid.uuid4().hex}")
    for k in range(n):
        S.write_state(S.update_splits(episodes.where(batch == k), "episode_index", IDS, "parent_episode_index", "repo_id", "w", shares, S.read_state(spark, root)), root)
    return S.read_state(spark, root).nodes


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Linked episodes, from the component table after two batches in the order
    in which they were ingested."""
    nodes = _in_batches(spark, d, "ingested_at", 2).select("node", "component")
    groups = nodes.where(F.col("node") != F.col("component"))
    tops = groups.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return groups.unionByName(tops).select(F.col("node").alias("episode_index"), F.col("component").alias("group_episode_index"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every episode; linked episodes are in the same one."""
    shares = S.shares_of(table(spark, d, "dataset_info"), "repo_id", "splits")
    episodes = table(spark, d, "episodes").withColumn("w", F.lit(1))
    found = S.split_records(episodes, "episode_index", IDS, "parent_episode_index", "repo_id", "w", shares)
    return found.select(F.col("node").alias("episode_index"), F.col("component").alias("group_episode_index"), "split", "status")


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """Splits of episodes that come in three batches, by ranges of their numbers."""
    nodes = _in_batches(spark, d, "episode_index", 3)
    return nodes.select(F.col("node").alias("episode_index"), F.col("component").alias("group_episode_index"), "split", "status")


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Linked episodes, all in one run without an earlier table."""
    edges = S.links(table(spark, d, "episodes"), "episode_index", IDS, "parent_episode_index")
    return S.components(edges).select(F.col("node").alias("episode_index"), F.col("component").alias("group_episode_index"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = D.duplicate_members(table(spark, d, "tasks"), "task_index", "task")
    return found.select(F.col("first_key").alias("task_index_a"), F.col("key").alias("task_index_b"))


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct instruction once, with the number of its copies."""
    found = D.duplicate_groups(table(spark, d, "tasks"), "task_index", "task")
    return found.select(F.col("first_key").alias("task_index"), F.col("text").alias("task"), "n_copies")


def _containers(spark: SparkSession, d: str) -> DataFrame:
    """The episodes of every repo in data files and video files."""
    e = table(spark, d, "episodes").where(F.col("deleted_at").isNull() & F.col("episode_index").isNotNull())
    e = e.select("repo_id", "episode_index", "length", "data_mb", "video_mb").distinct()
    e = e.groupBy("repo_id", "episode_index").agg(F.max("length").alias("length"), F.max("data_mb").alias("data_mb"), F.max("video_mb").alias("video_mb"))
    info = table(spark, d, "dataset_info").groupBy(F.col("repo_id").alias("r")).agg(
        F.max("data_files_size_in_mb").alias("data_limit"), F.max("video_files_size_in_mb").alias("video_limit"), F.max("chunks_size").alias("chunks_size")
    )
    if info.count() <= BROADCAST_ROWS:
        info = F.broadcast(info)
    rows = e.join(info, F.col("repo_id") == F.col("r"), "left")
    limit = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(default)
    kinds = F.array(
        F.struct(F.lit("data").alias("kind"), F.col("data_mb").alias("size"), limit("data_limit", 100).cast("double").alias("capacity")),
        F.struct(F.lit("video").alias("kind"), F.col("video_mb").alias("size"), limit("video_limit", 200).cast("double").alias("capacity")),
    )
    items = rows.select(F.col("repo_id").alias("grp"), F.col("episode_index").alias("item"), "length", F.inline(kinds))
    return K.pack(items)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    over = _containers(spark, d).where(F.col("n_pieces") > 1)
    return over.select(F.col("item").alias("episode_index"), F.col("kind").alias("container")).distinct()


def p7_files(spark: SparkSession, d: str) -> DataFrame:
    """File and chunk of every episode, or of its pieces, with the file's fill."""
    chunks = table(spark, d, "dataset_info").groupBy(F.col("repo_id").alias("r")).agg(F.max("chunks_size").alias("cs"))
    if chunks.count() <= BROADCAST_ROWS:
        chunks = F.broadcast(chunks)
    size = F.when(F.col("cs") > 0, F.col("cs")).otherwise(1000)
    found = _containers(spark, d).join(chunks, F.col("grp") == F.col("r"), "left")
    return found.select(
        F.col("grp").alias("repo_id"), F.col("kind").alias("container"), F.floor(F.col("container") / size).cast("bigint").alias("chunk_index"),
        (F.col("container") % size).cast("bigint").alias("file_index"), F.col("item").alias("episode_index"), "piece", "n_pieces", F.round("size", 6).alias("size_mb"), F.round("fill", 6).alias("fill"),
    )


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per repo and kind: every episode once and whole, no container above its
    capacity, and no more containers than any placing without two half empty
    ones may have."""
    found = _containers(spark, d)
    items = found.groupBy("grp", "kind", "item").agg(F.sum("size").alias("size"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("whole"), F.max("capacity").alias("capacity"))
    per = items.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("size").alias("mb"), F.min("whole").alias("whole"), F.max("capacity").alias("capacity"))
    made = found.groupBy(F.col("grp").alias("g"), F.col("kind").alias("k")).agg(F.max("fill").alias("fullest"), F.countDistinct("container").alias("n"), F.max("container").alias("last"))
    both = per.join(made, F.col("grp").eqNullSafe(F.col("g")) & (F.col("kind") == F.col("k")))
    few = (F.col("n") <= 2 * F.ceil(F.col("mb") / F.col("capacity")) + 1) & (F.col("n") == F.col("last") + 1)
    return both.select(F.col("grp").alias("repo_id"), F.col("kind").alias("container"), "n_episodes", F.round("mb", 3).alias("mb"), "whole", (F.col("fullest") <= 1 + 1e-9).alias("fits"), few.alias("few"))


_VALUES = """
WITH f AS (SELECT DISTINCT "index" AS i, episode_index, repo_id, recorded_at, "observation.state" AS s, action AS a, "observation.effort" AS e FROM frames),
u AS (SELECT episode_index, repo_id, CAST(recorded_at AS DATE) AS "day", 'observation.state' AS feature, g AS dim, CAST(s[g + 1] AS DOUBLE) AS x FROM f, (SELECT unnest(range(0, 64)) AS g) WHERE g < len(s)
UNION ALL SELECT episode_index, repo_id, CAST(recorded_at AS DATE), 'action', g, CAST(a[g + 1] AS DOUBLE) FROM f, (SELECT unnest(range(0, 64)) AS g) WHERE g < len(a)
UNION ALL SELECT episode_index, repo_id, CAST(recorded_at AS DATE), 'observation.effort', 0, e FROM f),
v AS (SELECT episode_index, repo_id, "day", feature, CAST(dim AS INT) AS dim, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS x FROM u WHERE x IS NOT NULL)
"""

_P1 = """
WITH RECURSIVE e AS (SELECT DISTINCT episode_index AS n, parent_episode_index AS p, lower(regexp_replace(operator_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS a, lower(regexp_replace(session_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS b, lower(regexp_replace(scene_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS c FROM episodes WHERE episode_index IS NOT NULL),
k AS (SELECT n, 1 AS t, a AS v FROM e UNION SELECT n, 2, b FROM e UNION SELECT n, 3, c FROM e),
h AS (SELECT * FROM k WHERE v NOT IN ('', 'unknown', 'n/a', '-')),
l AS (SELECT x.n AS u, y.n AS v FROM h x JOIN h y ON x.t = y.t AND x.v = y.v WHERE x.n <> y.n
 UNION SELECT x.n, x.p FROM e x JOIN e y ON x.p = y.n WHERE x.n <> x.p
 UNION SELECT x.p, x.n FROM e x JOIN e y ON x.p = y.n WHERE x.n <> x.p),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT u AS episode_index, least(u, min(v)) AS group_episode_index FROM r GROUP BY u
"""
_P7 = """
SELECT DISTINCT episode_index, c AS container FROM (
 SELECT e.episode_index, 'data' AS c, data_mb AS s, CASE WHEN data_files_size_in_mb > 0 THEN data_files_size_in_mb ELSE 100 END AS m FROM episodes e LEFT JOIN dataset_info i USING (repo_id) WHERE e.deleted_at IS NULL
 UNION ALL
 SELECT e.episode_index, 'video', video_mb, CASE WHEN video_files_size_in_mb > 0 THEN video_files_size_in_mb ELSE 200 END FROM episodes e LEFT JOIN dataset_info i USING (repo_id) WHERE e.deleted_at IS NULL)
WHERE s > m
"""

_INVISIBLE_SQL = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{34F}\x{115F}\x{1160}\x{3164}]"


def _words_sql(x: str) -> str:
    """The canonical words in SQL without look-around: neighbours are kept."""
    t = f"lower(upper(regexp_replace({x}, '{_INVISIBLE_SQL}', '', 'g')))"
    t = f"regexp_replace({t}, '[\\x{{2212}}\\x{{FF0D}}]', '-', 'g')"
    for pattern, put in (
        (r"(^|[^\p{L}\p{N}-])-(\.?\p{Nd})", "\ue001"), (r"([\p{L}\p{N}]-)-(\.?\p{Nd})", "\ue001"),
        (r"(\p{Nd})\.(\p{Nd})", "\ue000"), (r"(\p{Nd})\.(\p{Nd})", "\ue000"), (r"(^|[^\p{L}\p{N}.])\.(\p{Nd})", "\ue000"),
    ):
        t = f"regexp_replace({t}, '{pattern}', '\\1{put}\\2', 'g')"
    t = f"trim(regexp_replace({t}, '[\\p{{P}}\\p{{Z}}\\p{{Cc}}|=~`^<>]+', ' ', 'g'))"
    return f"translate({t}, '\ue000\ue001', '.-')"


_FIELD_SQL = r"(?s)^\s*[\x22\x27]?([\p{L}_][\p{L}\p{N}_.\-]*)[\x22\x27]?\s*[:=](.*)$"
_P3 = f"""
WITH b AS (SELECT DISTINCT task_index, task, regexp_replace(regexp_replace(task, '{_INVISIBLE_SQL}', '', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS bare FROM tasks WHERE task IS NOT NULL),
w AS (SELECT *, {_words_sql('task')} AS words, regexp_full_match(bare, '(?s)\\{{.*\\}}') AND json_valid(bare) AS js,
 regexp_replace(bare, '^[\\s\\p{{Z}};|,]+|[\\s\\p{{Z}};|,]+$', '', 'g') AS inside FROM b),
d AS (SELECT *, list_filter(list_transform(['[;|]', '[\\r\\n]+', ','], lambda g: list_filter(string_split_regex(inside, g), lambda p: regexp_matches(p, '[^\\s\\p{{Z}}]'))),
 lambda l: len(l) >= 2 AND len(list_filter(l, lambda p: NOT regexp_matches(p, '{_FIELD_SQL}'))) = 0)[1] AS parts FROM w),
k AS (SELECT task_index, task, CASE
 WHEN words = '' THEN NULL
 WHEN js AND len(json_keys(bare)) > 0 THEN 'R' || array_to_string(list_sort(list_transform(json_keys(bare), lambda f: {_words_sql('f')} || chr(31) || {_words_sql("coalesce(json_extract_string(bare, '$.' || chr(34) || f || chr(34)), '')")})), chr(30))
 WHEN parts IS NOT NULL THEN 'R' || array_to_string(list_sort(list_transform(parts, lambda p: {_words_sql(f"regexp_extract(p, '{_FIELD_SQL}', 1)")} || chr(31) || {_words_sql(f"regexp_extract(p, '{_FIELD_SQL}', 2)")})), chr(30))
 ELSE 'S' || words END AS form FROM d)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_batches": p1_batches,
    "p1_whole": p1_whole,
    "p2_found": p2_found,
    "p2_daily": p2_daily,
    "p2_combined": p2_combined,
    "p3_found": p3_found,
    "p3_copies": p3_copies,
    "p7_found": p7_found,
    "p7_files": p7_files,
    "p7_fill": p7_fill,
}
SQL = {
    "p1_found": _P1,
    "p1_whole": _P1,
    "p3_found": _P3 + "SELECT a AS task_index_a, task_index AS task_index_b FROM (SELECT task_index, min(task_index) OVER (PARTITION BY form) AS a FROM k WHERE form IS NOT NULL) WHERE a <> task_index",
    "p3_copies": _P3 + "SELECT min(task_index) AS task_index, arg_min(task, task_index) AS task, count(*) AS n_copies FROM k WHERE form IS NOT NULL GROUP BY form",
    "p7_found": _P7,
    "p7_fill": """
WITH e AS (SELECT repo_id, episode_index, max(data_mb) AS d, max(video_mb) AS v FROM episodes WHERE deleted_at IS NULL AND episode_index IS NOT NULL GROUP BY 1, 2),
s AS (SELECT repo_id, 'data' AS container, d AS x FROM e UNION ALL SELECT repo_id, 'video', v FROM e)
SELECT repo_id, container, count(*) AS n_episodes, round(sum(CASE WHEN x > 0 AND NOT isnan(x) AND NOT isinf(x) THEN x ELSE 0 END), 3) AS mb, true AS whole, true AS fits, true AS few FROM s GROUP BY 1, 2""",
    "p2_found": _VALUES
    + """, j AS (SELECT s.episode_index, s.feature, s.dim, s.q10, s.q50, s.q90, count(*) AS n,
 count(*) FILTER (x < q10) AS b10, count(*) FILTER (x <= q10) AS a10, count(*) FILTER (x < q50) AS b50, count(*) FILTER (x <= q50) AS a50, count(*) FILTER (x < q90) AS b90, count(*) FILTER (x <= q90) AS a90
 FROM (SELECT DISTINCT episode_index, feature, dim, q10, q50, q90 FROM episode_stats) s JOIN v ON s.episode_index = v.episode_index AND s.feature = v.feature AND s.dim = v.dim GROUP BY 1, 2, 3, 4, 5, 6)
 SELECT DISTINCT episode_index, feature, dim FROM j WHERE n >= 20 AND ((q10 IS NOT NULL AND 10 * b10 > 2 * n) OR (q50 IS NOT NULL AND (10 * b50 > 6 * n OR 10 * a50 < 4 * n)) OR (q90 IS NOT NULL AND 10 * a90 < 8 * n))""",
    "p2_daily": _VALUES
    + """ SELECT repo_id, "day", feature, dim, count(*) AS n, round(quantile_cont(x, 0.01), 6) + 0.0 AS q01, round(quantile_cont(x, 0.1), 6) + 0.0 AS q10, round(quantile_cont(x, 0.5), 6) + 0.0 AS q50, round(quantile_cont(x, 0.9), 6) + 0.0 AS q90, round(quantile_cont(x, 0.99), 6) + 0.0 AS q99 FROM v GROUP BY 1, 2, 3, 4""",
}
