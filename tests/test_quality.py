"""Orphan references, drifting schemas, small files."""

import json
import random

import numpy as np
import pytest
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from framelake.operators import common
from framelake.operators import compaction as C
from framelake.operators import drift as D
from framelake.operators import references as R


def _orphans(spark, refs, targets, **kw):
    shape = "id bigint, k bigint, seen timestamp_ntz, reason string, n string"
    r = spark.createDataFrame([(*x, "old", "clash") for x in refs], shape).withColumn("seen", F.to_timestamp_ntz(F.lit("2031-01-01 00:00:00")) + F.make_interval(days=F.col("id").cast("int") * 0 + F.lit(5)))
    t = spark.createDataFrame(targets, "k bigint, day int, gone int").select("k", (F.to_timestamp_ntz(F.lit("2031-01-01 00:00:00")) + F.make_interval(days=F.col("day"))).alias("ingested_at"), F.when(F.col("gone") == 1, F.lit("2032-01-01").cast("timestamp_ntz")).alias("deleted_at"))
    return sorted((x["id"], x["reason"]) for x in R.orphan_references(r, t, ["k"], seen="seen").collect())


def test_orphans(spark):
    targets = [(1, 0, 0), (2, 0, 1), (3, 9, 0), (4, None, 0), (5, 9, 1), (6, 0, 1), (6, 0, 0), (None, 0, 0)]
    refs = [(i, k, None) for i, k in enumerate([1, 2, 3, 4, 5, 6, 7, 7])]
    assert _orphans(spark, refs, targets) == [(1, "deleted"), (2, "late"), (4, "deleted"), (6, "missing"), (7, "missing")]
    assert _orphans(spark, refs, []) == [(i, "missing") for i in range(8)]
    assert _orphans(spark, [], targets) == []
    assert _orphans(spark, [(0, None, None)], targets) == []  # a null is no reference


def test_orphans_of_composite_keys(spark):
    r = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, None, 0), (4, "b", 0)], "id int, x string, y int").withColumn("seen", F.lit(None).cast("timestamp_ntz"))
    t = spark.createDataFrame([("a", 0), ("a", 0)], "x string, y int")
    got = {x["id"]: x["reason"] for x in R.orphan_references(r, t, ["x", "y"], seen="seen", available_at=None, deleted_at=None).collect()}
    assert got == {2: "missing", 3: "missing", 4: "missing"}


def test_lookup_join_splits_heavy_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    look = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    for limit in (0, 10**6):
        got = common.lookup_join(rows, look, ["k"], n_rows=3000, weight="n", broadcast_rows=limit)
        assert got.count() == 3000 and got.where("v != 2 * k").count() == 0


def test_promotions():
    assert D.promote("int", "bigint") == "bigint" and D.promote("bigint", "float") == "string" and D.promote("int", "float") == "double" and D.promote("bigint", "decimal(38,0)") == "decimal(38,0)" and D.promote("smallint", "float") == "float"
    assert D.promote("null", "date") == "date" and D.promote("date", "timestamp_ntz") == "timestamp_ntz" and D.promote("array<int>", "array<double>") == "array<double>"
    kinds = ["null", "tinyint", "smallint", "int", "bigint", "decimal(38,0)", "float", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz", "array<int>", "array<string>"]
    for a in kinds:
        for b in kinds:
            assert D.promote(a, b) == D.promote(b, a) and D.promote(a, D.promote(a, b)) == D.promote(a, b)
            for c in kinds:
                assert D.promote(a, D.promote(b, c)) == D.promote(D.promote(a, b), c)


def test_drifting_files(spark, tmp_path):
    tables = [pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["x", "y"]}), pa.table({"a": pa.array([3], pa.int64()), "b": ["z"], "c": [1.5]}), pa.table({"alpha": pa.array([4.5]), "c": pa.nulls(1)}), pa.table({"alpha": pa.array([], pa.float64())})]
    paths = []
    for i, t in enumerate(tables):
        paths.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(t, paths[-1])
    got, log = D.read_drifting(spark, paths, {"a": "alpha"})
    assert dict(got.dtypes) == {"alpha": "string", "b": "string", "c": "double"}  # 64 bits do not fit a double
    assert sorted((r["alpha"], r["b"], r["c"]) for r in got.na.fill("").na.fill(-1.0).collect()) == [("1", "x", -1), ("2", "y", -1), ("3", "z", 1.5), ("4.5", "", -1)]
    names = [p.rsplit("/")[-1] for p in paths]
    assert [(x["path"].rsplit("/")[-1], x["field"], x["change"]) for x in log.orderBy("ordinal").collect()] == [(names[1], "c", "added"), (names[1], "a", "retyped"), (names[2], "a", "renamed"), (names[2], "b", "removed"), (names[2], "c", "retyped"), (names[3], "c", "removed")]


def _info(**kw):
    f = {"x": {"dtype": "float32", "shape": [1], "names": None}, "y": {"dtype": "int64", "shape": [2], "names": ["a", "b"]}}
    return {"codebase_version": "v3.0", "data_path": "p", "fps": 10, "features": f, **kw}


def test_snapshot_changes(spark):
    base = _info()
    moved = json.loads(json.dumps(base))
    moved["features"]["z"] = moved["features"].pop("x")
    moved["features"]["z"]["shape"] = []
    moved["features"]["y"]["shape"] = [3]
    moved.update(codebase_version=" V3 ", fps="10", extra=None, robot="r")
    last = json.loads(json.dumps(moved))
    last.update(codebase_version="v2.1", data_path="q", arm=last.pop("robot"))
    del last["features"]["z"]
    rows = [(1, 1, json.dumps(base)), (1, 2, '{"codebase_version": "v3.0"'), (1, 3, None), (1, 4, json.dumps(moved)), (1, 4, json.dumps(moved)), (1, 6, json.dumps(last, indent=2)), (2, 1, "[]"), (2, 2, json.dumps(base)), (3, 1, json.dumps(base)), (3, 300, json.dumps({**base, "fps": 11, "new": {}})), (None, 1, json.dumps(base))]
    df = spark.createDataFrame(rows, "sid bigint, rev int, info string").withColumn("stream", F.lit("clash"))
    got = sorted(map(tuple, D.snapshot_changes(df, "sid", "rev", "info").collect()))
    assert got == [
        (1, 4, "features.x", "renamed", "features.z"), (1, 4, "features.y", "retyped", ""), (1, 4, "fps", "retyped", ""), (1, 4, "robot", "added", ""),
        (1, 6, "codebase_version", "changed", ""), (1, 6, "data_path", "changed", ""), (1, 6, "features.z", "removed", ""), (1, 6, "robot", "renamed", "arm"), (3, 300, "new", "added", ""),
    ]
    assert D.snapshot_changes(df.limit(0), "sid", "rev", "info").count() == 0
    table = D.unified_records(df, "sid", "rev", "info")
    assert dict(table.dtypes)["fps"] == "string" and table.count() == 6
    assert table.where("sid = 1 and rev = 4").first()["features"]["y"] == '["int64", [3]]'


def test_previous_across_blocks(spark):
    random.seed(1)
    orders = sorted(random.sample(range(5000), 300))
    df = spark.createDataFrame([("s", o, str(o)) for o in orders] + [("t", 7, "7")], "stream string, o int, v string")
    got = {(r["stream"], r["o"]): r["previous"] for r in D.with_previous(df, "stream", "o", "v", block=16).collect()}
    assert got[("t", 7)] is None and [got[("s", o)] for o in orders] == [None, *map(str, orders[:-1])]


def test_hilbert_curve():
    n = 16
    x, y = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
    d = C.hilbert_index(x, y, 4)
    assert sorted(d) == list(range(n * n))
    order = np.argsort(d)
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()


def test_small_files(spark, tmp_path):
    line = lambda e, f, v=0: json.dumps({"episode_index": e, "frame_index": f, "v": v})
    bodies = [
        (1, "r", 1, line(1, 0) + "\n" + line(1, 1) + "\n"), (2, "r", 2, "﻿" + line("1", " 1 ", 5) + "\r\n" + line(1.0, 2)), (3, "q", 3, '{"episode_index": 1, "frame_in'), (4, "q", 4, ""), (5, None, 5, None),
        (6, "q", 6, "x " + line(1e0, 3) + ",\n\n[1]\n" + line(None, 3) + "\n" + line(1, 1.5)), (7, "q", 7, line(1, 3) + "\n" + line(1, 3)),
    ]
    files = spark.createDataFrame(bodies, "file_id bigint, repo_id string, written_at int, body string").withColumn("code", F.lit(1)).withColumn("part", F.lit("clash"))
    steps = C.deduplicate_steps(C.staged_steps(files), "file_id", "written_at")
    limits = spark.createDataFrame([("r", 0, None), ("q", 1, 1)], "repo_id string, limit_mb int, chunks_size int")
    placed = C.assign_files(steps, limits).cache()
    got = {(r["episode_index"], r["frame_index"]): (r["several"], r["repo_id"]) for r in placed.collect()}
    assert got == {(1, 0): (False, "r"), (1, 1): (True, "r"), (1, 2): (False, "r"), (1, 3): (True, "q")}
    assert json.loads(placed.where("frame_index = 1").first()["step"])["v"] == 5  # the newest copy
    named = placed.withColumn("path", C.fill_template(F.lit("{chunk_index:03d}-{file_index}-{episode_index:02d}/").substr(1, 100), F.col("chunk_index"), F.col("file_index"), F.col("file")))
    assert {r["path"] for r in named.collect()} == {"000-0-00/"}
    named = named.withColumn("path", F.concat_ws("/", "repo_id", F.lit("a.parquet")))
    assert C.write_files(named, steps, str(tmp_path)).agg(F.sum("n_written")).first()[0] == 4
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    same = lambda d: sorted(map(tuple, C.digest(d, ["repo_id"]).collect()))
    assert same(back) == same(steps)
    assert C.assign_files(steps.limit(0), limits).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_files_are_even_and_compact(spark, tmp_path, hot):
    """Files keep the limit and hold compact ranges of codes that do not overlap,
    also where nearly all steps lie in a small part of the coordinates."""
    n = 20_000
    steps = spark.range(n).select(
        (F.when(F.col("id") < 3, F.col("id") * 100_000).otherwise(F.col("id") / 100) if hot else F.col("id") / 100).cast("bigint").alias("episode_index"), (F.col("id") % 100).alias("frame_index"),
        F.when(F.col("id") % 10 == 0, None).otherwise("r").alias("repo_id"), F.repeat(F.lit("x"), 499).alias("step"), F.lit(7).alias("part"),
    )
    placed = C.assign_files(steps, spark.createDataFrame([("r", 1, 4)], "repo_id string, limit_mb int, chunks_size int")).withColumn("path", F.concat_ws("/", F.coalesce("repo_id", F.lit("none")), F.col("file").cast("string")))
    sizes = placed.where("repo_id = 'r'").groupBy("chunk_index", "file_index").agg(F.sum(F.octet_length("step") + 1).alias("b")).collect()
    assert len(sizes) == 9 and max(r["b"] for r in sizes) <= 2**20 and min(r["b"] for r in sizes) > 0.9 * 18_000 * 500 / 9
    assert {r["chunk_index"] for r in sizes} == {0, 1, 2}
    parts = placed.groupBy("path").agg(F.countDistinct("part").alias("n")).collect()
    assert len(parts) == 10 and {r["n"] for r in parts} == {1}
    written = sorted((r for r in C.write_files(placed, steps, str(tmp_path)).collect() if r["path"].startswith("r/")), key=lambda r: r["first_code"])
    assert sum(r["n_written"] for r in written) == 18_000
    assert all(a["last_code"] < b["first_code"] for a, b in zip(written, written[1:]))


def test_one_code_larger_than_a_file(spark):
    steps = spark.range(6000).select(F.when(F.col("id") == 0, 10**12).otherwise(F.col("id") % 50).alias("episode_index"), (F.col("id") / 50).cast("bigint").alias("frame_index"), F.lit("r").alias("repo_id"), F.repeat(F.lit("x"), 999).alias("step"))
    sizes = C.assign_files(steps, spark.createDataFrame([("r", 1, 4)], "repo_id string, limit_mb int, chunks_size int")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("p")).collect()
    assert sum(r["n"] for r in sizes) == 6000 and {r["p"] for r in sizes} == {1} and len(sizes) >= 6
