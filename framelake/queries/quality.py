"""Queries of the general data-quality operators (problems 4, 5 and 6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction as C
from ..operators import drift as D
from ..operators import references as R
from ..operators.common import checkpoint_dir, store
from ..operators.indexing import small
from ..sources.files import local
from .base import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of both tables; the two fields of frames share every scan."""
    frames, episodes = table(spark, d, "frames"), table(spark, d, "episodes")
    tasks, files = table(spark, d, "tasks"), table(spark, d, "data_files")
    month = F.year("recorded_at") * 12 + F.month("recorded_at")
    times = ("ingested_at", "deleted_at")
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("k")) for f in ("task_index", "episode_index")]
    refs = frames.select(F.col("index").alias("row_key"), "ingested_at", "recorded_at", F.inline(F.array(*fields))).where(F.col("k").isNotNull())
    targets = [t.select(F.lit(f).alias("field"), F.col(f).alias("k"), *times) for f, t in (("task_index", tasks), ("episode_index", episodes))]
    found = R.orphan_references(refs, targets[0].unionByName(targets[1]), ["field", "k"], seen="ingested_at", period=month)
    parts = [found.select(F.lit("frames").alias("table_name"), "field", "row_key", "reason", "recorded_at")]
    cols = [F.col("repo_id").alias("k0"), F.col("`data/chunk_index`").alias("k1"), F.col("`data/file_index`").alias("k2")]
    refs = episodes.where(F.col("`data/file_index`").isNotNull()).select(
        F.col("episode_index").alias("row_key"), *cols, "ingested_at", "recorded_at"
    )
    found = R.orphan_references(refs, files.select(*cols, *times), ["k0", "k1", "k2"], seen="ingested_at", period=month)
    parts.append(found.select(F.lit("episodes").alias("table_name"), F.lit("data/file_index").alias("field"), "row_key", "reason", "recorded_at"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphaned reference of frames and episodes."""
    return _orphans(spark, d).select("table_name", "field", "row_key", "reason").distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned references per table, field, month of recording and reason."""
    orphans = _orphans(spark, d).withColumn("month", F.date_format("recorded_at", "yyyy-MM"))
    return R.orphan_counts(orphans, "row_key", ["table_name", "field", "month", "reason"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = D.snapshot_changes(table(spark, d, "info_snapshots"), "stream_id", "revision", "info")
    return found.select(F.col("stream").alias("stream_id"), "revision", "field", "change_kind", "new_field")


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """All readable snapshots in one table of consistent columns."""
    return D.unified_records(table(spark, d, "info_snapshots"), "stream_id", "revision", "info")


def _drifting_files(spark: SparkSession, d: str) -> list[str]:
    """Events in parquet files of three schemas, one for each third of the range
    of event_id: numbers widen, fields are renamed, added and dropped."""
    events = table(spark, d, "events")
    lo, hi = events.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    third = F.floor((F.col("event_id") - lo) * 3 / (hi - lo + 1))
    versions = (
        [F.col("event_id").cast("int").alias("event_id"), F.col("user_id").cast("int").alias("user_id"), "value", F.col("event_type").alias("kind")],
        ["event_id", F.col("user_id").cast("int").alias("user_id"), "value", "event_type", "props"],
        ["event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "props"],
    )
    paths = []
    for k, columns in enumerate(versions):
        root = f"{checkpoint_dir(spark).rstrip('/')}/drift-{uuid.uuid4().hex}"
        events.where(third == k).select(*columns).write.parquet(root)
        paths += sorted(spark.read.parquet(root).inputFiles())
    return paths


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose schemas drift, read as one table of the folded schema."""
    return D.read_drifting(spark, _drifting_files(spark, d), {"kind": "event_type"})[0]


def p5_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changes from file to file, from their headers."""
    return D.read_drifting(spark, _drifting_files(spark, d), {"kind": "event_type"})[1].select("field", "change", "detail")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the staged files once, as a stored table."""
    return store(C.deduplicate_steps(C.staged_steps(table(spark, d, "staged_files")), "file_id", "written_at"))


def _placed(spark: SparkSession, d: str, steps: DataFrame) -> DataFrame:
    info = table(spark, d, "dataset_info").groupBy("repo_id").agg(F.max("data_files_size_in_mb").alias("limit_mb"), F.max("chunks_size").alias("chunks_size"), F.max("data_path").alias("template"))
    placed = C.assign_files(steps, info.select("repo_id", "limit_mb", "chunks_size"))
    named = placed.join(small(info.select("repo_id", "template")), "repo_id", "left")
    path = C.fill_template(F.col("template"), F.col("chunk_index"), F.col("file_index"), F.col("file"))
    return named.withColumn("path", F.concat_ws("/", "repo_id", path)).drop("template")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Steps that several staged files held, from the consolidated rows."""
    steps = _steps(spark, d)
    placed = C.range_shuffle(_placed(spark, d, steps), steps)
    return placed.where("several").select("episode_index", "frame_index")


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that hold every step once: place, size and row digest."""
    return C.digest(_placed(spark, d, _steps(spark, d)), ["repo_id", "chunk_index", "file_index", "path"])


def p6_written(spark: SparkSession, d: str) -> DataFrame:
    """Writes the files to the shared folder and compares the row digests of
    the staged steps, before any placing, with those of what is read back."""
    steps = _steps(spark, d)
    root = os.path.join(local(checkpoint_dir(spark)), f"compacted-{uuid.uuid4().hex}")
    C.write_files(_placed(spark, d, steps), steps, root).agg(F.sum("n_written")).collect()
    back = spark.read.option("recursiveFileLookup", "true").schema("episode_index bigint, frame_index bigint, repo_id string, step string").parquet(root)
    wanted = C.digest(steps, ["repo_id"])
    held = C.digest(back, ["repo_id"]).select(F.col("repo_id").alias("r"), *[F.col(c).alias(f"{c}_read") for c in ("n_steps", "size_bytes", "digest_xor", "digest_sum")])
    both = wanted.join(held, F.col("repo_id").eqNullSafe(F.col("r")), "full")
    same = F.lit(True)
    for c in ("n_steps", "size_bytes", "digest_xor", "digest_sum"):
        same = same & F.coalesce(F.col(c) == F.col(f"{c}_read"), F.lit(False))
    return both.select("repo_id", "n_steps", "size_bytes", same.alias("same"))


_P4 = """
WITH t AS (SELECT task_index AS k, bool_and(deleted_at IS NOT NULL) AS gone, coalesce(min(ingested_at) FILTER (deleted_at IS NULL), min(ingested_at)) AS since FROM tasks WHERE task_index IS NOT NULL GROUP BY 1),
e AS (SELECT episode_index AS k, bool_and(deleted_at IS NOT NULL) AS gone, coalesce(min(ingested_at) FILTER (deleted_at IS NULL), min(ingested_at)) AS since FROM episodes WHERE episode_index IS NOT NULL GROUP BY 1),
f AS (SELECT repo_id AS r, "data/chunk_index" AS c, "data/file_index" AS k, bool_and(deleted_at IS NOT NULL) AS gone, coalesce(min(ingested_at) FILTER (deleted_at IS NULL), min(ingested_at)) AS since FROM data_files GROUP BY 1, 2, 3),
o AS (
SELECT 'frames' AS table_name, 'task_index' AS field, "index" AS row_key, recorded_at, CASE WHEN t.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > a.ingested_at THEN 'late' END AS reason FROM frames a LEFT JOIN t ON a.task_index = t.k WHERE a.task_index IS NOT NULL
UNION
SELECT 'frames', 'episode_index', "index", recorded_at, CASE WHEN e.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > a.ingested_at THEN 'late' END FROM frames a LEFT JOIN e ON a.episode_index = e.k WHERE a.episode_index IS NOT NULL
UNION
SELECT 'episodes', 'data/file_index', episode_index, recorded_at, CASE WHEN f.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN since > a.ingested_at THEN 'late' END FROM episodes a LEFT JOIN f ON a.repo_id = f.r AND a."data/chunk_index" = f.c AND a."data/file_index" = f.k WHERE a."data/file_index" IS NOT NULL)
"""

_STEPS = """
WITH l AS (SELECT file_id, repo_id, written_at, regexp_extract(unnest(string_split(body, chr(10))), '\\{.*\\}') AS j FROM staged_files WHERE body IS NOT NULL),
s AS (SELECT file_id, repo_id, j, written_at, CAST(TRY_CAST(trim(json_extract_string(j, '$.episode_index')) AS DOUBLE) AS BIGINT) AS episode_index, CAST(TRY_CAST(trim(json_extract_string(j, '$.frame_index')) AS DOUBLE) AS BIGINT) AS frame_index FROM l WHERE j <> '' AND json_valid(j))
"""

_P5 = """
WITH a AS (SELECT stream_id, revision, min(info) AS info FROM info_snapshots WHERE info IS NOT NULL AND json_valid(info) AND json_type(CASE WHEN json_valid(info) THEN info END) = 'OBJECT' GROUP BY 1, 2),
p AS (SELECT stream_id, revision, lag(revision) OVER (PARTITION BY stream_id ORDER BY revision) AS before FROM a),
k AS (SELECT stream_id, revision, info, unnest(json_keys(info)) AS f FROM a),
t AS (SELECT stream_id, revision, f AS field, json_extract(info, '$."' || f || '"') AS v FROM k WHERE f <> 'features'),
n AS (SELECT stream_id, revision, info, unnest(json_keys(info, '$.features')) AS f FROM a WHERE json_type(info, '$.features') = 'OBJECT'),
g AS (SELECT stream_id, revision, 'features.' || f AS field, json_extract(info, '$.features."' || f || '"') AS v FROM n),
h AS (SELECT *, coalesce(json_extract_string(v, '$.dtype'), '') || '|' || CASE WHEN replace(CAST(v->'$.shape' AS VARCHAR), ' ', '') = '[]' THEN '[1]' ELSE coalesce(replace(CAST(v->'$.shape' AS VARCHAR), ' ', ''), 'null') END AS kind FROM g WHERE json_type(v) <> 'NULL'),
fields AS (
SELECT stream_id, revision, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, CAST(v AS VARCHAR) AS content, 0 AS part FROM t WHERE json_type(v) <> 'NULL'
UNION ALL
SELECT stream_id, revision, field, kind, kind || '|' || CAST(coalesce(v->'$.names', 'null') AS VARCHAR) || '|' || CAST(coalesce(v->'$.description', 'null') AS VARCHAR), 1 FROM h),
o AS (SELECT p.stream_id, p.revision, f.field, f.kind, f.content, f.part FROM p JOIN fields f ON f.stream_id = p.stream_id AND f.revision = p.before),
c AS (SELECT p.stream_id, p.revision, f.field, f.kind, f.content, f.part FROM p JOIN fields f ON f.stream_id = p.stream_id AND f.revision = p.revision WHERE p.before IS NOT NULL),
gone AS (SELECT *, row_number() OVER (PARTITION BY stream_id, revision, part, kind, content ORDER BY field) AS i FROM o ANTI JOIN c USING (stream_id, revision, field)),
come AS (SELECT *, row_number() OVER (PARTITION BY stream_id, revision, part, kind, content ORDER BY field) AS i FROM c ANTI JOIN o USING (stream_id, revision, field)),
moved AS (SELECT stream_id, revision, part, gone.field AS old, come.field AS fresh FROM gone JOIN come USING (stream_id, revision, part, kind, content, i)),
b AS (SELECT stream_id, revision, field, o.kind AS k1, c.kind AS k2, o.content AS c1, c.content AS c2 FROM o JOIN c USING (stream_id, revision, field)),
alias AS (SELECT *, lower(trim(json_extract_string(CASE WHEN field = 'codebase_version' THEN c1 END, '$'))) AS v1, lower(trim(json_extract_string(CASE WHEN field = 'codebase_version' THEN c2 END, '$'))) AS v2 FROM b WHERE field = 'codebase_version'),
std AS (SELECT *, CASE WHEN v1 IN ('v2.1', 'v2', '2.1') THEN 'a' WHEN v1 IN ('v3.0', 'v3', '3.0') THEN 'b' ELSE v1 END AS w1, CASE WHEN v2 IN ('v2.1', 'v2', '2.1') THEN 'a' WHEN v2 IN ('v3.0', 'v3', '3.0') THEN 'b' ELSE v2 END AS w2 FROM alias)
SELECT stream_id, revision, old AS field, 'renamed' AS change_kind, fresh AS new_field FROM moved
UNION ALL SELECT stream_id, revision, field, 'removed', '' FROM gone WHERE (stream_id, revision, field) NOT IN (SELECT (stream_id, revision, old) FROM moved)
UNION ALL SELECT stream_id, revision, field, 'added', '' FROM come WHERE (stream_id, revision, field) NOT IN (SELECT (stream_id, revision, fresh) FROM moved)
UNION ALL SELECT stream_id, revision, field, 'retyped', '' FROM b WHERE k1 <> k2
UNION ALL SELECT stream_id, revision, field, 'changed', '' FROM b WHERE field = 'data_path' AND c1 <> c2
UNION ALL SELECT stream_id, revision, field, 'changed', '' FROM std WHERE w1 <> w2
"""

QUERIES = {
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_unified": p5_unified,
    "p5_files": p5_files,
    "p5_file_changes": p5_file_changes,
    "p6_found": p6_found,
    "p6_files": p6_files,
    "p6_written": p6_written,
}
SQL = {
    "p5_found": _P5,
    "p5_files": "WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), e AS (SELECT *, floor((event_id - lo) * 3 / (hi - lo + 1)) AS k FROM events, b) SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CASE WHEN k < 2 THEN value END AS value, CASE WHEN k > 0 THEN props END AS props FROM e",
    "p5_file_changes": "SELECT * FROM (VALUES ('kind', 'renamed', 'event_type'), ('props', 'added', 'string'), ('event_id', 'retyped', 'int to bigint'), ('value', 'removed', 'double'), ('user_id', 'retyped', 'int to string')) AS t(field, change, detail)",
    "p6_found": _STEPS + "SELECT episode_index, frame_index FROM s WHERE episode_index IS NOT NULL AND frame_index IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT file_id) > 1",
    "p6_written": _STEPS
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY episode_index, frame_index ORDER BY written_at DESC NULLS LAST, file_id DESC NULLS LAST, j DESC, repo_id DESC NULLS LAST) AS k FROM s WHERE episode_index IS NOT NULL AND frame_index IS NOT NULL)
 SELECT repo_id, count(*) AS n_steps, CAST(sum(strlen(j) + 1) AS BIGINT) AS size_bytes, true AS same FROM b WHERE k = 1 GROUP BY 1""",
    "p4_found": _P4 + "SELECT DISTINCT table_name, field, row_key, reason FROM o WHERE reason IS NOT NULL",
    "p4_counts": _P4 + "SELECT table_name, field, strftime(recorded_at, '%Y-%m') AS month, reason, count(DISTINCT row_key) AS n_orphans FROM o WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
}
