"""Recording, staging, statistics of media, and outputs of the command line."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import cli
from framelake.functions.features import FeatureError, FeatureSpec, owned_features, parse_stats_mode
from framelake.plans import build as B
from framelake.plans import validate as V
from framelake.plans import writer as W
from framelake.sources import media
from framelake.sources.dataset import read_dataset
from tests.test_image_stats_written import _png
from tests.test_pipelines import _mp4

FEATURES = {"state": FeatureSpec("float32", (2,)), "grip": FeatureSpec("int64", (1,)), "cam": FeatureSpec("image", (4, 4, 3))}


def frame(i, **kw):
    return {"state": [i, i / 2], "grip": i, "cam": _png((20 * i, 0, 255)), "task": "push" if i % 2 else "pull", **kw}


def test_frames_are_checked(tmp_path):
    w = W.EpisodeWriter(str(tmp_path), 0, FEATURES)
    for bad in ({"other": 1}, {"grip": None}, {"state": [1.0]}, {"state": [[1.0, 2.0]]}):
        with pytest.raises(FeatureError):
            w.add_frame(frame(1, **bad))
    with pytest.raises(ValueError, match="no frames"):
        w.save()
    state = np.array([1.0, 2.0])
    w.add_frame(frame(1, state=state))
    state[0] = 9  # the writer holds a copy
    assert w.rows[0]["state"] == [1.0, 2.0]


@pytest.mark.parametrize("version", ["v2.1", "v3.0"])
def test_recorded_dataset(spark, tmp_path, version):
    root = str(tmp_path / "out")
    w = W.DatasetWriter(spark, root, FEATURES, 10, version=version, flush_frames=3)
    with pytest.raises(ValueError):
        w.save_episode()
    for n in (7, 2):
        for i in range(n):
            w.add_frame(frame(i))
        w.save_episode()
    w.add_frame(frame(0))  # never saved
    w.finalize()
    report = V.validate(spark, root)
    assert report.ok and not report.warnings, report.problems
    d = read_dataset(spark, root)
    assert [r[0] for r in d.frames.orderBy("index").select("grip").collect()] == [*range(7), 0, 1]
    assert [r["tasks"] for r in d.episodes.orderBy("episode_index").collect()] == [["pull", "push"]] * 2
    assert W.integrity(root) == [] and not os.path.exists(w.staging)
    # statistics that are lost are filled in again, and only those
    stats = d.stats.where("feature <> 'cam' or episode_index = 1")
    filled = B.complete_media(B.replace(d, stats=stats))
    assert sorted(map(tuple, filled.stats.collect())) == sorted(map(tuple, d.stats.collect()))
    os.remove(os.path.join(root, "meta/stats.json"))
    assert W.integrity(root) == ["no statistics of cam"]


def test_staging(spark, tmp_path):
    staging = str(tmp_path / "staged")
    for e, n in ((4, 3), (2, 1), (9, 2)):
        w = W.EpisodeWriter(staging, e, FEATURES)
        for i in range(n):
            w.add_frame(frame(i))
        if e != 9:
            w.save()
    assert [(r["episode_index"], r["length"]) for r in W.staged_episodes(spark, staging).orderBy("episode_index").collect()] == [(2, 1), (4, 3)]
    with open(tmp_path / "features.json", "w") as f:
        json.dump({k: v.to_dict() for k, v in FEATURES.items()}, f)
    create = ["create", "--staging", staging, "--features", str(tmp_path / "features.json"), "--fps", "10", "--version", "v3.0", "--stats-mode", "FULL", "-o", str(tmp_path / "made")]
    assert cli.main(create) == 0
    assert [r["length"] for r in read_dataset(spark, str(tmp_path / "made")).episodes.orderBy("episode_index").collect()] == [1, 3]
    assert cli.main([*create[:-1], os.path.join(staging, "inside")]) == 1
    os.remove(os.path.join(staging, "ep_000004", "frames-00000.parquet"))
    with pytest.raises(ValueError, match="0 staged frames, 3 in its manifest"):
        W.from_staging(spark, staging, FEATURES, 10, version="v3.0")
    with pytest.raises(ValueError, match="no staged"):
        W.from_staging(spark, str(tmp_path / "made" / "meta"), FEATURES, 10, version="v3.0")


def test_force_loses_nothing(spark, tmp_path, monkeypatch):
    steps = spark.range(6).select((F.col("id") % 2).alias("episode"), F.col("id").alias("step"), F.lit("t").alias("task"), F.col("id").alias("v"))
    for name in ("a", "b"):
        B.save(B.build(steps, {"v": FeatureSpec("int64", (1,))}, 10, episode="episode", order=["step"], task="task", version="v3.0"), str(tmp_path / name))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    files = lambda p: sorted(os.path.join(at, n) for at, _, names in os.walk(p) for n in names)
    before = files(a), files(b)
    for out in (a, a + "/", os.path.join(a, "sub"), str(tmp_path)):
        assert cli.main(["convert", "-i", a, "-o", out, "--to", "v2.1", "--force"]) == 1
    os.symlink(a, tmp_path / "link")
    assert cli.main(["convert", "-i", a, "-o", str(tmp_path / "link"), "--to", "v2.1", "--force"]) == 1
    with monkeypatch.context() as m:
        m.setattr(B, "save", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
        assert cli.main(["convert", "-i", a, "-o", b, "--to", "v2.1", "--force"]) == 1
    assert (files(a), files(b)) == before and sorted(os.listdir(tmp_path)) == ["a", "b", "link"]
    assert cli.main(["convert", "-i", a, "-o", b, "--to", "v2.1"]) == 1
    assert cli.main(["convert", "-i", a, "-o", b, "--to", "v2.1", "--force"]) == 0
    assert V.validate(spark, b).version == "v2.1" and sorted(os.listdir(tmp_path)) == ["a", "b", "link"]


def test_modes_and_strict_union(spark, capsys):
    assert [parse_stats_mode(m) for m in ("", " Sample ", "FULL", "none")] == ["sampled", "sampled", "full", "none"]
    with pytest.raises(FeatureError):
        parse_stats_mode("half")
    assert set(owned_features({**FEATURES, "v": FeatureSpec("video", (4, 5, 3))}, True)) == set(FEATURES)
    left = spark.range(2)
    assert B._union([left, left.select(F.when(F.col("id") > 0, F.col("id")).alias("id"))]).count() == 4
    with pytest.raises(ValueError, match="schemas differ"):
        B._union([left, left.select(F.col("id").cast("int").alias("id"))])
    assert cli.main(["completion"]) == 0 and "complete -F" in capsys.readouterr().out


def test_cameras(tmp_path):
    """Frames and streams of cameras, with a program that gives a ready video."""
    ready, tool = tmp_path / "ready.mp4", tmp_path / "tool"
    ready.write_bytes(_mp4(2, 10 * 512, 512))
    tool.write_text(f'#!/bin/sh\nfor last; do :; done\ncat > /dev/null\ncp {ready} "$last"\n')
    tool.chmod(0o755)
    features = {"grip": FEATURES["grip"], "top": FeatureSpec("video", (2, 3, 3)), "side": FeatureSpec("video", (2, 3, 3))}
    w = W.EpisodeWriter(str(tmp_path / "s"), 0, features, fps=10, program=str(tool))
    for bad in (("other", b"x" * 18, 3, 2), ("top", b"x" * 17, 3, 2)):
        with pytest.raises(FeatureError):
            w.add_rgb(*bad)
    for i in range(2):
        w.add_frame({"grip": i})
        w.add_rgb("top", bytes(18), 3, 2)
    with pytest.raises(ValueError, match="no video of side"):
        w.save()
    assert w.save(videos={"top": "top.rgb.mp4"}, streams={"side": str(ready)})["videos"] == {"top": "top.rgb.mp4", "side": "side.mp4"}
    for i in range(2):
        (tmp_path / f"frame-{i}.png").write_bytes(_png((i, 0, 0)))
    assert media.encode_images(str(tmp_path), str(tmp_path / "made.mp4"), 10, str(tool)) == 2
    w = W.EpisodeWriter(str(tmp_path / "s"), 1, features, fps=10, program=str(tool))
    w.add_frame({"grip": 1})
    w.add_rgb("top", bytes(18), 3, 2)
    with pytest.raises(media.MediaError, match="2 frames in the stream, 1 in the episode"):
        w.save(streams={"side": str(ready)})
