"""Datasets written, read, converted, united, validated, and streamed."""

import glob
import json
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framelake import cli
from framelake.functions.features import FeatureError, FeatureSpec
from framelake.plans import build as B
from framelake.plans import validate as V
from framelake.sources import media
from framelake.sources.dataset import load_info, read_dataset, read_episodes
from framelake.sources.files import footers, listing
from framelake.streaming import flush

FEATURES = {"observation.state": FeatureSpec("float32", (2,), names=["a", "b"], extra={"description": "arm"}), "action": FeatureSpec("float32", (2,))}


def steps(spark, *episodes):
    rows = [(e, i, task, [float(i), i + 0.5], [0.1 * (i + 1), 0.2]) for e, (task, n) in enumerate(episodes) for i in range(n)]
    return spark.createDataFrame(rows, "episode int, step int, task string, `observation.state` array<float>, action array<float>")


def made(spark, root, *episodes, version="v3.0", **kw):
    d = B.build(steps(spark, *episodes), FEATURES, 10, episode="episode", order=["step"], task="task", version=version, robot_type="robot", **kw)
    return B.save(d, str(root))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    for v in ("v2.1", "v3.0"):
        made(spark, base / v, ("pick cube", 3), ("place cube", 4), version=v)
    return base


@pytest.mark.parametrize("version", ["v2.1", "v3.0"])
def test_write_and_validate(spark, both, version):
    root = str(both / version)
    report = V.validate(spark, root)
    assert report.ok and not report.warnings and report.summary == f"{version}: 2 episodes, 7 frames, 2 tasks"
    info = load_info(root)
    assert (info.total_episodes, info.total_frames, info.total_tasks, info.splits) == (2, 7, 2, {"train": "0:2"})
    assert info.features["observation.state"].extra == {"description": "arm"}
    d = read_dataset(spark, root)
    assert [tuple(r) for r in d.episodes.orderBy("episode_index").select("dataset_from_index", "dataset_to_index", "tasks").collect()] == [(0, 3, ["pick cube"]), (3, 7, ["place cube"])]
    assert [round(r[0], 4) for r in d.frames.orderBy("index").select("timestamp").collect()] == [0, 0.1, 0.2, 0, 0.1, 0.2, 0.3]
    tops = {r["feature"]: r["max"] for r in d.stats.where("episode_index = 1 and dim = 0").collect()}
    assert tops["index"] == 6 and tops["task_index"] == 1 and tops["observation.state"] == 3
    file = sorted(glob.glob(f"{root}/data/*/*.parquet"))[0]
    schema = pq.read_schema(file)
    assert str(schema.field("action").type).startswith("fixed_size_list") and b"huggingface" in schema.metadata
    assert pq.read_metadata(file).row_group(0).column(0).compression == "SNAPPY"
    assert json.load(open(f"{root}/meta/stats.json"))["action"]["count"] == [7]
    assert read_episodes(spark, d, [1]).count() == 4


def test_rotation_by_size_and_count(spark, tmp_path):
    d = made(spark, tmp_path / "one", ("a", 2), ("a", 2), episodes_per_file=1)
    assert [tuple(r) for r in d.episodes.orderBy("episode_index").select("`data/chunk_index`", "`data/file_index`").collect()] == [(0, 0), (0, 1)]
    assert len(glob.glob(str(tmp_path / "one/data/*/*.parquet"))) == 2 and V.validate(spark, str(tmp_path / "one")).ok
    wide = {"observation.state": FeatureSpec("float32", (600_000,)), "action": FeatureSpec("float32", (1,))}
    rows = spark.createDataFrame([(e, i, float(i)) for e in range(2) for i in range(2)], "episode int, step int, action float").withColumn("observation.state", F.array_repeat(F.lit(1.0).cast("float"), 600_000)).withColumn("task", F.lit("t"))
    big = B.build(rows, wide, 10, episode="episode", order=["step"], task="task", with_stats=False, data_files_size_in_mb=1)
    assert [r[0] for r in big.episodes.orderBy("episode_index").select("`data/file_index`").collect()] == [0, 1]


def test_conversion_and_union(spark, both, tmp_path):
    for source, to in (("v2.1", "v3.0"), ("v3.0", "v2.1")):
        d = B.save(B.convert(read_dataset(spark, str(both / source)), to), str(tmp_path / to))
        assert V.validate(spark, str(tmp_path / to)).ok
        assert d.info.features["observation.state"].extra == {"description": "arm"}
        same = lambda r: sorted(map(tuple, read_dataset(spark, str(r)).frames.select("index", "task_index", "`observation.state`").collect()))
        assert same(tmp_path / to) == same(both / source)
    with pytest.raises(ValueError):
        B.convert(read_dataset(spark, str(both / "v3.0")), "v3")
    a, b = read_dataset(spark, str(both / "v3.0")), read_dataset(spark, str(both / "v2.1"))
    u = B.save(B.union([a, b], "v3.0"), str(tmp_path / "u"))
    assert V.validate(spark, str(tmp_path / "u")).ok and (u.info.total_episodes, u.info.total_frames, u.info.total_tasks) == (4, 14, 2)
    tops = {r["feature"]: r["max"] for r in u.stats.where("episode_index = 3 and dim = 0").collect()}
    assert tops["index"] == 13 and tops["episode_index"] == 3 and tops["observation.state"] == 3
    for change in ({"fps": 20}, {"robot_type": "other"}, {"features": {"action": FEATURES["action"]}}):
        other = read_dataset(spark, str(both / "v3.0"))
        other.info = B.replace(other.info, **change)
        with pytest.raises(ValueError):
            B.union([a, other])
    with pytest.raises(ValueError):
        B.union([a])


def test_frames_are_checked(spark):
    with pytest.raises(FeatureError):
        B.build(steps(spark, ("a", 1)).drop("action"), FEATURES, 10, episode="episode", order=["step"], task="task")
    with pytest.raises(FeatureError):
        B.build(steps(spark, ("a", 1)), {**FEATURES, "top": FeatureSpec("video", (4, 4, 3))}, 10, episode="episode", order=["step"], task="task", use_videos=False)


def test_validation_finds_faults(spark, both, tmp_path):
    assert not V.validate(spark, str(tmp_path / "none")).ok
    for name, change, wanted in (
        ("counts", {"total_frames": 9, "total_episodes": 3, "total_tasks": 3}, {"total_frames", "total_episodes", "task_gap", "total_tasks", "splits"}),
        ("version", {"codebase_version": "v9"}, {"version"}),
        ("path", {"data_path": "data/x.parquet"}, {"data_path"}),
    ):
        root = tmp_path / name
        shutil.copytree(both / "v3.0", root)
        d = json.load(open(root / "meta/info.json"))
        json.dump({**d, **change}, open(root / "meta/info.json", "w"))
        report = V.validate(spark, str(root))
        assert wanted <= {c for _, c, _, _ in report.problems} and not report.ok, name
    root = tmp_path / "gone"
    shutil.copytree(both / "v2.1", root)
    os.remove(glob.glob(str(root / "data/*/episode_000001.parquet"))[0])
    assert "missing_file" in {c for _, c, _, _ in V.validate(spark, str(root)).problems}
    root = tmp_path / "gap"
    shutil.copytree(both / "v3.0", root)
    file = glob.glob(str(root / "data/*/*.parquet"))[0]
    t = pq.read_table(file)
    pq.write_table(t.filter([i != 4 for i in range(7)]), file)
    codes = {c for _, c, _, _ in V.validate(spark, str(root)).problems}
    assert {"index_gap", "length", "total_frames"} <= codes
    pq.write_table(t.drop(["action"]), file)
    assert "missing_column" in {c for _, c, _, _ in V.validate(spark, str(root)).problems}


def test_schema_diff(spark, both):
    a, b = load_info(str(both / "v2.1")), load_info(str(both / "v3.0"))
    b.fps = 20
    del b.features["action"]
    assert [r["field"] for r in V.schema_diff(spark, a, b).collect()] == ["codebase_version", "features.action", "fps"]


def test_frames_are_in_the_files_named(spark, tmp_path):
    root = str(tmp_path / "d")
    made(spark, root, ("a", 3), ("b", 4), ("c", 2), episodes_per_file=1)
    assert V.validate(spark, root).ok
    one, two = (os.path.join(root, f"data/chunk-000/file-00{i}.parquet") for i in (1, 2))
    os.rename(one, one + ".x")
    os.rename(two, one)
    os.rename(one + ".x", two)
    report = V.validate(spark, root)
    assert {(c, n) for (_, c), n in report.counts.items()} == {("file_range", 2)} and not report.ok
    other = str(tmp_path / "e")
    made(spark, other, ("a", 3), ("b", 6))
    assert [tuple(r) for r in V.file_diff(spark, root, other).collect()] == [("files", "3", "1")]
    first = {r["path"]: r["digest"] for r in V.manifest(spark, root).collect()}
    os.rename(one, one + ".x")
    os.rename(two, one)
    os.rename(one + ".x", two)
    second = {r["path"]: r["digest"] for r in V.manifest(spark, root).collect()}
    assert first.keys() == second.keys() and {k for k in first if first[k] != second[k]} == {"data/chunk-000/file-001.parquet", "data/chunk-000/file-002.parquet"}


def test_files(spark, both):
    root = str(both / "v3.0")
    assert {r["path"] for r in listing(spark, root).collect()} >= {"meta/info.json", "data/chunk-000/file-000.parquet"}
    f = footers(spark, glob.glob(f"{root}/data/*/*.parquet")).first()
    assert f["n_rows"] == 7 and f["uncompressed_mb"] > 0


def test_command_line(spark, both, tmp_path, capsys):
    assert cli.main(["version"]) == 0
    assert cli.main(["validate", str(both / "v3.0")]) == 0 and cli.main(["validate", str(tmp_path / "none")]) == 1
    assert cli.main(["--json", "validate", str(both / "v2.1"), "--no-strict"]) == 0
    out = str(tmp_path / "converted")
    assert cli.main(["convert", "-i", str(both / "v3.0"), "-o", out, "--to", "2.1"]) == 0
    assert cli.main(["convert", "-i", str(both / "v3.0"), "-o", out, "--to", "2.1"]) == 1  # not empty
    assert cli.main(["merge", "-o", str(tmp_path / "merged"), "--to", "v3", "-i", str(both / "v3.0"), out]) == 0
    assert cli.main(["merge", "-o", str(tmp_path / "m2"), "--to", "v3", "-i", out, out + "/"]) == 1  # the same twice
    assert cli.distinct_paths(["a/b/", "a//b", "c"]) == ["a/b", "c"]
    with pytest.raises(ValueError):
        cli.clean_path(" ")


def test_stream(spark, tmp_path):
    rows = [("e1", i, t, i == 4) for i, t in enumerate(["a", "b", "a", "c", "b"])] + [("e2", 0, None, False)]
    shape = "ep string, t int, task string, last boolean"
    for i in range(0, 6, 2):  # three micro-batches of two rows
        spark.createDataFrame(rows[i : i + 2], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flush.staged(flush.numbered(source, episode="ep", order="t", task="task", fps=10, last="last"), str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ep", "t").select("ep", "frame_index", "local_task").collect()]
    assert got == [("e1", 0, 0), ("e1", 1, 1), ("e1", 2, 0), ("e1", 3, 2), ("e1", 4, 1), ("e2", 0, 0)]


def _box(kind, body):
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def _mp4(frames, scale, delta, width=64, height=48, offsets=(), begins=0):
    u32 = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    entry = b"\0" * 24 + width.to_bytes(2, "big") + height.to_bytes(2, "big") + b"\0" * 50
    stsd = _box(b"stsd", u32(0, 1) + _box(b"avc1", entry))
    stts = _box(b"stts", u32(0, 1, frames, delta))
    mdia = _box(b"mdia", _box(b"mdhd", u32(0, 0, 0, scale, frames * delta, 0)) + _box(b"hdlr", u32(0, 0) + b"vide" + b"\0" * 12) + _box(b"minf", _box(b"stbl", stsd + stts + (_box(b"ctts", u32(0, len(offsets), *[x for o in offsets for x in (1, o)])) if offsets else b""))))
    edit = _box(b"edts", _box(b"elst", u32(0, 1, frames * delta, begins, 1 << 16))) if begins else b""
    return _box(b"ftyp", b"isom") + _box(b"mdat", b"x" * 1000) + _box(b"moov", _box(b"trak", edit + mdia))


def test_media(spark, tmp_path):
    good, bad = tmp_path / "a.mp4", tmp_path / "b.mp4"
    good.write_bytes(_mp4(8, 10 * 512, 512))
    bad.write_bytes(b"nothing")
    m = media.probe_mp4(good.read_bytes())
    assert (m["width"], m["height"], m["codec"], m["frames"], m["duration"]) == (64, 48, "avc1", 8, 0.8)
    probed = media.probe(spark, [str(good), str(bad)])
    wanted = spark.createDataFrame([(str(good), 8), (str(bad), 8), (str(tmp_path / "c.mp4"), 1)], "path string, frames bigint")
    assert {os.path.basename(r["path"]) for r in media.video_errors(probed, wanted, 10.0).collect()} == {"b.mp4", "c.mp4"}
    assert {r["reason"] for r in media.video_errors(probed, wanted, 20.0).where("path like '%a.mp4'").collect()} == {"frame rate"}
    media.concatenate([str(good)], str(tmp_path / "x/copy.mp4"), 10)
    assert (tmp_path / "x/copy.mp4").read_bytes() == good.read_bytes()
    if not shutil.which("ffmpeg"):
        with pytest.raises(media.MediaError):
            media.concatenate([str(good), str(good)], str(tmp_path / "x/two.mp4"), 10)


def test_frames_stored_in_another_order(tmp_path):
    """Frames I P B B: shown 0 3 1 2, two frames late, which the edit list takes back."""
    path = tmp_path / "b.mp4"
    path.write_bytes(_mp4(4, 10 * 512, 512, offsets=(1024, 2048, 512, 512), begins=1024))
    m = media.probe_mp4(media.read_moov(str(path)))
    assert [round(t, 9) for t in m["pts"]] == [0.0, 0.1, 0.2, 0.3] and m["duration"] == 0.4 and not m["has_audio"]
    assert media.feature_info(str(path), 10)["video.codec"] == "h264"
    assert [t > 0.05 for t in media.probe_mp4(_mp4(4, 10 * 512, 512, offsets=(1024, 2048, 512, 512)))["pts"]] == [True] * 4
    with pytest.raises(media.MediaError):
        media.read_moov(__file__)
    assert media.decode_warnings("\n deprecated pixel format used, x\n bad frame \n") == ["bad frame"]
    tool = tmp_path / "tool"
    for said, want in (("ffmpeg version n6.1", "-fps_mode"), ("ffmpeg version 4.4.2", "-vsync"), ("?", "-vsync")):
        tool.write_text(f"#!/bin/sh\necho '{said}'\n")
        tool.chmod(0o755)
        media._majors.clear()
        assert media.passthrough_rate(str(tool))[0] == want


def test_videos_are_placed(spark, tmp_path):
    features = {"action": FEATURES["action"], "top": FeatureSpec("video", (48, 64, 3))}
    rows = []
    for e in range(2):
        (tmp_path / f"{e}.mp4").write_bytes(_mp4(3 + e, 10 * 512, 512) + bytes(700_000))
        rows.append((e, "top", str(tmp_path / f"{e}.mp4"), None, None))
    videos = spark.createDataFrame(rows, "episode_index bigint, camera string, path string, start double, stop double")
    raw = steps(spark, ("a", 3), ("b", 4)).drop("observation.state")
    build = lambda v: B.build(raw, features, 10, episode="episode", order=["step"], task="task", version="v3.0", videos=v, video_files_size_in_mb=1)
    with pytest.raises(ValueError):
        B.save(build(videos.where("episode_index = 0")), str(tmp_path / "lacking"))
    d = B.save(build(videos), str(tmp_path / "v30"))
    assert [tuple(r) for r in d.episodes.orderBy("episode_index").select("`videos/top/file_index`", "`videos/top/from_timestamp`", "`videos/top/to_timestamp`").collect()] == [(0, 0.0, 0.3), (1, 0.0, 0.4)]
    old = B.save(B.convert(read_dataset(spark, str(tmp_path / "v30")), "v2.1"), str(tmp_path / "v21"))
    assert old.info.total_videos == 2
    for e in range(2):
        assert (tmp_path / f"v21/videos/chunk-000/top/episode_{e:06d}.mp4").read_bytes() == (tmp_path / f"{e}.mp4").read_bytes()
    codes = {c for _, c, _, _ in V.validate(spark, str(tmp_path / "v21")).problems}
    assert "video" not in codes and "stats_coverage" in codes  # pixels need a decoder, so their statistics are the caller's
