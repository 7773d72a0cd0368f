"""Features, layout, scalar functions, numbering, tasks and rotation."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import layout as L
from framelake.functions import scalars as S
from framelake.functions.features import FeatureError, FeatureSpec, arrow_schema, check_columns, check_media, data_columns, features_equal, parse_features, struct_type, with_defaults
from framelake.operators import indexing as X
from framelake.operators import rotation as R
from framelake.operators import stats as A
from framelake.operators import tasks as K

VECTOR = {"observation.state": FeatureSpec("float32", (2,)), "action": FeatureSpec("float32", (2,))}


def test_feature_types():
    f = with_defaults({**VECTOR, "cam": FeatureSpec("image", (4, 4, 3)), "top": FeatureSpec("video", (4, 4, 3)), "done": FeatureSpec("bool", (1,)), "grid": FeatureSpec("float64", (2, 3))})
    assert "top" not in data_columns(f)
    s = struct_type(f)
    assert s["done"].dataType == T.BooleanType() and s["grid"].dataType == T.ArrayType(T.ArrayType(T.DoubleType()))
    a = arrow_schema(f)
    assert a.field("observation.state").type == pa.list_(pa.float32(), 2)
    assert a.field("grid").type == pa.list_(pa.list_(pa.float64(), 3), 2)
    assert a.names == sorted(a.names) and b"huggingface" in a.metadata
    with pytest.raises(FeatureError):
        struct_type({"x": FeatureSpec("complex64", (1,))})


def test_features_keep_extra_keys():
    spec = FeatureSpec.of({"dtype": "float32", "shape": [2], "names": ["x", "y"], "description": "arm", "fps": 10})
    assert spec.to_dict()["description"] == "arm" and spec.to_dict()["fps"] == 10
    assert features_equal({"a": spec}, {"a": FeatureSpec.of(spec.to_dict())})
    assert not features_equal({"a": spec}, {"a": FeatureSpec("float32", (2,))})
    with pytest.raises(FeatureError):
        parse_features("{}")


def test_config_checks():
    with pytest.raises(FeatureError):
        check_media({"top": FeatureSpec("video", (4, 4, 3))}, False)
    check_columns(["observation.state", "action", "task"], VECTOR)
    for cols in (["action"], ["observation.state", "action", "other"]):
        with pytest.raises(FeatureError):
            check_columns(cols, VECTOR)


def test_layout():
    assert L.fill(L.DATA_PATH["v3.0"], chunk_index=1, file_index=2) == "data/chunk-001/file-002.parquet"
    assert L.fill(L.DATA_PATH["v2.1"], episode_chunk=1, episode_index=1000) == "data/chunk-001/episode_001000.parquet"
    assert L.fill("{name}/{n:03d}/{other}", name="a", n=1234) == "a/1234/{other}"
    assert [L.parse_version(v) for v in (" V2.1", "3", "v3")[:1] + ("v3", "2.1")] == ["v2.1", "v3.0", "v2.1"]
    with pytest.raises(ValueError):
        L.parse_version("v4")
    info = L.DatasetInfo.new("v2.1", 10, VECTOR, robot_type="r")
    info.total_episodes = 2
    again = L.DatasetInfo.from_json(info.to_json())
    assert again.splits == {"train": "0:2"} and again.total_videos == 0 and again.features["action"].shape == (2,)
    assert L.DatasetInfo.from_json(L.DatasetInfo.new("3.0", 10, VECTOR).to_json()).total_chunks is None


@pytest.mark.parametrize("n,samples,first,last", [(0, 0, [], []), (1, 1, [0], [0]), (8, 8, [0, 1, 2, 3], [6, 7]), (150, 100, [0, 2, 3, 5], [147, 149]), (1000, 177, [0, 6, 11, 17], [993, 999]), (25650, 2026, [0, 13, 25, 38], [25636, 25649]), (300000, 10000, [0, 30, 60, 90], [299969, 299999])])
def test_sampling(spark, n, samples, first, last):
    got = spark.range(1).select(S.sample_indices(F.lit(n).cast("bigint"))).first()[0]
    assert len(got) == samples and got[: len(first)] == first and got[len(got) - len(last) :] == last
    assert spark.range(1).select(S.sample_count(F.lit(n))).first()[0] == samples


def test_scalars(spark):
    df = spark.createDataFrame([("30000/1001", "yuv420p"), ("0/0", "gray10le"), ("", "rgba"), ("25", "nv12"), (None, None)], "r string, p string")
    rows = df.select(S.frame_rate(F.col("r")), S.pixel_channels(F.col("p")), S.safe_key(F.col("p"))).collect()
    assert [r[0] for r in rows[:4]] == [30.0, 0.0, 0.0, 25.0] and [r[1] for r in rows] == [3, 1, 4, None, None]
    v = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double").select(S.finite(F.col("x"))).collect()
    assert [r[0] for r in v] == [1.0, 0.0, 0.0, None]
    kv = spark.createDataFrame([("a=1\nb = x=y\n\nc",)], "t string").select(S.key_values(F.col("t"))).first()[0]
    assert kv == {"a": "1", "b": "x=y"}


def test_statistics_of_two_episodes(spark):
    rows = [(e, i, [float(i), i + 0.5], [0.1 * (i + 1), 0.2]) for e, n in ((0, 3), (1, 4)) for i in range(n)]
    frames = spark.createDataFrame(rows, "episode_index int, frame_index int, `observation.state` array<float>, action array<float>")
    stats = A.episode_stats(frames, {"observation.state": 1, "action": 1}).cache()
    s0 = stats.where("episode_index = 0 and feature = 'observation.state' and dim = 0").first()
    assert (s0["min"], s0["max"], s0["mean"], s0["count"]) == (0, 2, 1, 3)
    assert math.isclose(s0["std"], 0.816496, abs_tol=1e-6)
    assert [round(s0[q], 6) for q in S.QUANTILE_NAMES] == [0.02, 0.2, 1, 1.8, 1.98]
    whole = A.dataset_stats(stats).where("feature = 'observation.state' and dim = 0").first()
    assert whole["count"] == 7 and round(whole["mean"], 6) == 1.285714 and round(whole["std"], 6) == 1.030158
    assert round(whole["q50"], 6) == 1.285714 and round(whole["q90"], 6) == 2.314286


def test_statistics_merge_and_sanitise(spark):
    cols = "episode_index int, feature string, dim int, count bigint, min double, max double, mean double, std double"
    parts = spark.createDataFrame([(0, "x", 0, 10, 0.0, 1.0, 0.5, 0.1), (1, "x", 0, 10, -1.0, 2.0, 1.0, 0.2)], cols)
    for q in S.QUANTILE_NAMES:
        parts = parts.withColumn(q, F.lit(None).cast("double"))
    m = A.dataset_stats(parts).first()
    assert (m["count"], m["min"], m["max"], m["mean"]) == (20, -1, 2, 0.75) and round(m["std"], 6) == 0.295804
    assert m["q50"] == 0.75  # the means stand in for percentiles that are missing
    odd = spark.createDataFrame([(0, 1.0), (0, float("inf")), (0, float("nan")), (0, None)], "episode_index int, x double")
    s = A.episode_stats(odd, {"x": 0}).first()
    assert s["count"] == 3 and round(s["mean"], 6) == 0.333333
    empty = A.dataset_stats(parts.withColumn("count", F.lit(0).cast("bigint"))).first()
    assert empty["mean"] == 0 and empty["count"] == 0


def test_flatten_and_overlay(spark):
    cols = "episode_index bigint, feature string, dim int, count bigint, " + ", ".join(f"{s} double" for s in A.STATS)
    row = lambda e, f, d, v: (e, f, d, 3, *[v] * len(A.STATS))
    long = spark.createDataFrame([row(0, "a/b", 0, 1.0), row(0, "a/b", 2, 2.0), row(1, "c", 0, 3.0)], cols)
    wide = A.flatten_stats(long, ["a/b", "c"])
    assert wide.where("episode_index = 0").first()["stats/a/b/mean"] == [1.0, None, 2.0]
    back = sorted(map(tuple, A.unflatten_stats(wide).select(*long.columns).collect()))
    assert back == sorted(map(tuple, long.collect()))
    over = spark.createDataFrame([row(0, "a/b", 0, 9.0)], cols)
    assert sorted(r["mean"] for r in A.overlay(long, over).collect()) == [3.0, 9.0]
    missing = A.missing_media({"cam": FeatureSpec("image", (2, 2, 3)), "c": FeatureSpec("float32")}, long.select("episode_index", "feature"))
    assert sorted(map(tuple, missing.collect())) == [(0, "cam"), (1, "cam")]


def test_indices(spark):
    rows = [(u, t) for u, n in ((7, 3), (3, 2), (9, 1)) for t in range(n)]
    f = spark.createDataFrame(rows, "user int, t int")
    f = f.join(X.dense_index(f, "user", "episode_index"), "user")
    f = X.with_timestamp(X.frame_index(f, "episode_index", ["t"]), 10)
    f = X.global_index(f, X.episode_ranges(f)).cache()
    got = [tuple(r) for r in f.orderBy("index").select("user", "frame_index", "index").collect()]
    assert got == [(3, 0, 0), (3, 1, 1), (7, 0, 2), (7, 1, 3), (7, 2, 4), (9, 0, 5)]
    assert all(r["contiguous"] and r["starts_right"] for r in X.contiguity(f).collect())
    assert X.check_slice(f, 2, 5).count() == 3
    for a, b in ((4, 9), (5, 5)):
        with pytest.raises(ValueError):
            X.check_slice(f, a, b)
    assert X.timestamp_steps(f, 10).count() == 0 and X.timestamp_steps(f, 20).count() == 2


def test_ranked_over_partitions(spark):
    import random

    keys = random.Random(4).sample(range(10**6), 3000)
    got = X.ranked(spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7), ["k"], "place").collect()
    assert {r["k"]: r["place"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}
    assert X.ranked(spark.range(0), ["id"], "place").count() == 0


def test_running_sum_in_blocks(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["s"] for r in X.running_sum(df, "id", "v", "s", block=64).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_chain(spark):
    rows = [(0, 2, 0, 2), (1, 3, 2, 5), (2, 1, 6, 7), (2, 1, 6, 7), (3, 5, 7, 11)]
    df = spark.createDataFrame(rows, "episode_index bigint, length bigint, dataset_from_index bigint, dataset_to_index bigint")
    bad = {(r[0], r["broken_chain"], r["wrong_length"], r["duplicate"]) for r in X.chain_errors(df).collect()}
    assert (3, False, True, False) in bad and (2, True, False, True) in bad and not any(b[0] in (0, 1) for b in bad)


def test_tasks(spark):
    frames = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (1, 0, "a"), (1, 1, None)], "episode_index bigint, frame_index bigint, task string")
    per = K.episode_tasks(frames)
    d = K.task_dictionary(per)
    assert {r["task"]: r["task_index"] for r in d.collect()} == {"b": 0, "a": 1, "": 2}
    # numbers local to an episode are told apart from global ones: here both are 0 and 1
    local = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (0, 1, "z"), (0, 5, "w")], "episode_index bigint, task_index bigint, tag string")
    got = {r["tag"]: r["task_index"] for r in K.remap_local(local, per, d).collect()}
    assert got == {"x": 1, "y": 2, "z": 1, "w": None}
    sources = spark.createDataFrame([(0, 0, "p"), (0, 1, "q"), (1, 0, "q"), (1, 1, "r")], "source int, task_index bigint, task string")
    u = K.union_dictionary(sources)
    assert {r["task"]: r["task_index"] for r in u.collect()} == {"p": 0, "q": 1, "r": 2}
    assert K.first_task_gap(d.where("task_index != 1"), 3).first()[0] == 1 and K.first_task_gap(d, 3).count() == 0


def test_rotation(spark):
    w = spark.createDataFrame(list(enumerate([40.0, 50.0, 30.0, 100.0, 10.0])), "episode_index int, mb double")
    files = lambda **k: [r["file"] for r in R.rotate(w, ["episode_index"], "mb", 100.0, **k).orderBy("episode_index").collect()]
    assert files() == [0, 0, 1, 2, 3] and files(after=False) == [0, 0, 1, 2, 3] and files(most=1) == [0, 1, 2, 3, 4]
    g = spark.createDataFrame([("a", 0, 60.0), ("a", 1, 60.0), ("b", 0, 60.0), ("b", 1, None)], "cam string, e int, mb double")
    got = {(r["cam"], r["e"]): (r["file"], r["from_timestamp"]) for r in R.media_offsets(R.rotate(g, ["e"], "mb", 100.0, group=["cam"]).withColumn("dur", F.lit(2.0)), ["cam"], "e", "dur").collect()}
    assert got == {("a", 0): (0, 0.0), ("a", 1): (1, 0.0), ("b", 0): (0, 0.0), ("b", 1): (0, 2.0)}


def test_image_statistics(spark):
    import struct
    import zlib

    from framelake.functions.images import decode_png, image_stats

    def png(r, g, b, n=8):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\x00" + bytes([r, g, b]) * n for _ in range(n))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    assert decode_png(png(1, 2, 3)).shape == (8, 8, 3)
    frames = spark.createDataFrame([(0, i, {"bytes": png(40 * i, 10, 20), "path": None}) for i in range(4)], "episode_index bigint, frame_index bigint, cam struct<bytes: binary, path: string>")
    got = {r["dim"]: r for r in image_stats(frames, "cam").collect()}
    assert [round(got[d]["mean"] * 255, 6) for d in range(3)] == [60, 10, 20] and got[0]["count"] == 4
    assert round(got[0]["q50"] * 255, 6) == 60 and round(got[0]["max"] * 255) == 120
