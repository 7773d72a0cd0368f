"""Episodes that are recorded one after another, staged, and made a dataset.

A staged episode is a folder ``ep_<number>`` with its frames in parquet files and
a manifest, written last; folders without a manifest do not count.  Recorders may
stage on many machines at once: a dataset is made from all staged episodes by one
plan, in which only manifests are listed.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Mapping
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import DEFAULT_FEATURES, FeatureError, Features, arrow_type, keys_of, spark_type
from ..operators.indexing import dense_index, small
from ..sources import media
from ..sources.dataset import Dataset
from ..sources.files import local
from . import build as B

MANIFEST = "episode_meta.json"
#: Frames held in memory before they are written.
FLUSH_FRAMES = 256
_MANIFEST_TYPE = "episode_index bigint, length bigint, tasks array<string>, frames_parquet string, videos map<string, string>"


def staging_dir(root: str, episode: int) -> str:
    return os.path.join(local(root), f"ep_{episode:06d}")


class EpisodeWriter:
    """Stages one episode: frames are checked, held up to ``flush_frames`` and
    written; ``save`` writes the manifest and so completes the episode."""

    def __init__(self, staging: str, episode: int, features: Features, *, fps: int = 0, flush_frames: int = FLUSH_FRAMES, program: str | None = None) -> None:
        self.fps, self.program, self.sizes = fps, program, {}
        self.features = {k: v for k, v in features.items() if k not in DEFAULT_FEATURES and v.dtype != "video"}
        self.cameras = keys_of(features, "video")
        self.at, self.episode, self.flush_frames = staging_dir(staging, episode), episode, max(1, flush_frames)
        self.schema = pa.schema([("episode_index", pa.int64()), ("frame_index", pa.int64()), ("task", pa.string()), *[(k, arrow_type(v)) for k, v in sorted(self.features.items())]])
        self.rows: list[dict] = []
        self.frames, self.files, self.tasks = 0, 0, []
        shutil.rmtree(self.at, ignore_errors=True)
        os.makedirs(self.at)

    def check(self, frame: Mapping[str, Any]) -> dict:
        """The frame as it is stored; unknown, missing, null or misshapen values
        are an error.  What the caller holds may change afterwards."""
        unknown = sorted(frame.keys() - self.features.keys() - {"task"})
        missing = sorted(k for k in self.features if frame.get(k) is None)
        if unknown or missing:
            raise FeatureError(f"unknown values {unknown}, missing values {missing}")
        row = {"task": frame.get("task") or ""}
        for name, spec in self.features.items():
            value = frame[name]
            if spec.dtype == "image":
                row[name] = {"bytes": bytes(value), "path": None}
            elif not spec.numeric or spec.scalar:
                row[name] = np.asarray(value).reshape(-1)[0].item() if spec.numeric else str(value)
            else:
                array = np.asarray(value)
                if array.shape != tuple(spec.shape):
                    raise FeatureError(f"{name} has shape {array.shape} instead of {tuple(spec.shape)}")
                row[name] = array.tolist()
        return row

    def add_frame(self, frame: Mapping[str, Any]) -> None:
        row = self.check(frame)
        if row["task"] not in self.tasks:
            self.tasks.append(row["task"])
        self.rows.append({"episode_index": self.episode, "frame_index": self.frames, **row})
        self.frames += 1
        if len(self.rows) >= self.flush_frames:
            self._flush()

    def add_rgb(self, camera: str, data: bytes, width: int, height: int) -> None:
        """A frame of a camera as RGB24; all of a camera are of one size.  They
        wait on disk and are encoded when the episode is saved."""
        if camera not in self.cameras:
            raise FeatureError(f"unknown camera {camera}")
        if len(data) != width * height * 3 or self.sizes.setdefault(camera, (width, height)) != (width, height):
            raise FeatureError(f"{camera}: {len(data)} bytes are no frame of {width} x {height}")
        with open(self._raw(camera), "ab") as f:
            f.write(data)

    def _raw(self, camera: str) -> str:
        return os.path.join(self.at, "".join(c if c.isalnum() else "_" for c in camera) + ".rgb")

    def _encoded(self, camera: str) -> str:
        """The video of a camera's frames, which must be those of the episode."""
        (width, height), raw = self.sizes[camera], self._raw(camera)
        size = width * height * 3
        if os.path.getsize(raw) != size * self.frames:
            raise ValueError(f"{camera}: {os.path.getsize(raw) // size} frames of {self.frames}")
        with open(raw, "rb") as f:
            media.encode_rgb(iter(lambda: f.read(size), b""), width, height, self.fps, raw + ".mp4", self.program)
        os.remove(raw)
        return os.path.basename(raw + ".mp4")

    def _flush(self) -> None:
        if self.rows:
            pq.write_table(pa.Table.from_pylist(self.rows, schema=self.schema), os.path.join(self.at, f"frames-{self.files:05d}.parquet"))
            self.rows, self.files = [], self.files + 1

    def save(self, videos: Mapping[str, str] | None = None, streams: Mapping[str, str] | None = None) -> dict:
        """Completes the episode; every camera needs a video that is not empty:
        one that is given, a raw H.264 stream, or the frames that were added."""
        if not self.frames:
            raise ValueError("no frames in the episode")
        videos = dict(videos or {})
        for camera, stream in (streams or {}).items():
            made = self._raw(camera).removesuffix(".rgb") + ".mp4"
            media.remux_h264(local(stream), made, self.fps, self.frames, self.program)
            videos[camera] = os.path.basename(made)
        for camera in self.sizes.keys() - videos.keys():
            videos[camera] = self._encoded(camera)
        for camera in self.cameras:
            path = videos.get(camera)
            full = path and os.path.join(self.at, local(path))
            if not full or not os.path.exists(full) or not os.path.getsize(full):
                raise ValueError(f"episode {self.episode}: no video of {camera}")
        self._flush()
        manifest = {"episode_index": self.episode, "length": self.frames, "tasks": self.tasks, "frames_parquet": "frames-*.parquet", "videos": videos}
        temp = os.path.join(self.at, f".{uuid.uuid4().hex}")
        with open(temp, "w") as f:
            json.dump(manifest, f, indent=2)
        os.replace(temp, os.path.join(self.at, MANIFEST))
        return manifest

    def drop(self) -> None:
        shutil.rmtree(self.at, ignore_errors=True)


class DatasetWriter:
    """Records episodes in order and makes the dataset at ``root`` of them.

    An episode that was not saved when the dataset is finalised is dropped.
    ``options`` are those of ``build``.
    """

    def __init__(self, spark: SparkSession, root: str, features: Features, fps: int, *, staging: str | None = None, flush_frames: int = FLUSH_FRAMES, **options: Any) -> None:
        self.spark, self.root, self.features, self.fps, self.options = spark, root, features, fps, options
        self.staging = staging or f"{local(root).rstrip('/')}.staging-{uuid.uuid4().hex}"
        self.flush_frames, self.episodes = flush_frames, 0
        self.open: EpisodeWriter | None = None

    def add_frame(self, frame: Mapping[str, Any]) -> None:
        if self.open is None:
            self.open = EpisodeWriter(self.staging, self.episodes, self.features, fps=self.fps, flush_frames=self.flush_frames)
        self.open.add_frame(frame)

    def add_rgb(self, camera: str, data: bytes, width: int, height: int) -> None:
        if self.open is None:
            raise ValueError("a frame comes before its pictures")
        self.open.add_rgb(camera, data, width, height)

    def save_episode(self, videos: Mapping[str, str] | None = None, streams: Mapping[str, str] | None = None) -> int:
        """Gives the number of the saved episode."""
        if self.open is None:
            raise ValueError("no frames in the episode")
        self.open.save(videos, streams)
        self.open, self.episodes = None, self.episodes + 1
        return self.episodes - 1

    def finalize(self) -> Dataset:
        if self.open is not None:
            self.open.drop()
            self.open = None
        made = B.save(from_staging(self.spark, self.staging, self.features, self.fps, **self.options), self.root)
        faults = integrity(self.root)
        if faults:
            raise ValueError(faults[0])
        shutil.rmtree(self.staging, ignore_errors=True)
        return made


def staged_episodes(spark: SparkSession, staging: str) -> DataFrame:
    """Columns of the manifests, and dir, of all completed episodes; paths of
    videos are relative to the episode's folder unless they are absolute."""
    base = local(staging).rstrip("/")
    text = spark.read.option("pathGlobFilter", MANIFEST).option("recursiveFileLookup", "true").text(base, wholetext=True)
    m = F.from_json("value", _MANIFEST_TYPE)
    where = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    rows = text.select(m.alias("m"), F.regexp_replace(F.url_decode(where), r"/[^/]*$", "").alias("dir"))
    rows = rows.where(F.col("dir").rlike(r"/ep_[^/]*$") & F.col("m.episode_index").isNotNull())
    videos = F.transform_values(F.coalesce("m.videos", F.create_map().cast("map<string,string>")), lambda k, v: F.when(v.startswith("/") | v.contains("://"), v).otherwise(F.concat_ws("/", "dir", v)))
    return rows.select("m.episode_index", "m.length", "m.tasks", videos.alias("videos"), "dir")


def from_staging(spark: SparkSession, staging: str, features: Features, fps: int, **options: Any) -> Dataset:
    """The dataset of all staged episodes, numbered without gaps in their order.

    An episode whose frames are not as many as its manifest says is an error.
    """
    found = staged_episodes(spark, staging)
    own = {k: v for k, v in features.items() if k not in DEFAULT_FEATURES and v.dtype != "video"}
    columns = ["episode_index bigint", "frame_index bigint", "task string", *[f"`{k}` {spark_type(v).simpleString()}" for k, v in sorted(own.items())]]
    if not found.limit(1).count():
        raise ValueError(f"no staged episodes in {staging}")
    steps = spark.read.schema(", ".join(columns)).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(local(staging))
    steps = steps.join(small(found.select("episode_index")), "episode_index", "left_semi")  # completed ones only
    held = steps.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    wrong = found.join(held, "episode_index", "left").where(F.coalesce("n", F.lit(0)) != F.col("length")).select("episode_index", "length", "n").first()
    if wrong is not None:
        raise ValueError(f"episode {wrong[0]}: {wrong[2] or 0} staged frames, {wrong[1]} in its manifest")
    videos = None
    if keys_of(features, "video"):
        number = dense_index(found, "episode_index", "__new")
        null = F.lit(None).cast("double")
        videos = found.join(small(number), "episode_index").select(F.col("__new").alias("episode_index"), F.explode("videos").alias("camera", "path")).select("*", null.alias("start"), null.alias("stop"))
    return B.build(steps, features, fps, episode="episode_index", order=["frame_index"], task="task", videos=videos, **options)


def integrity(root: str, *, external_videos: bool = False) -> list[str]:
    """What an output lacks: data files, statistics of media, videos.

    ``external_videos`` leaves the statistics of videos to the caller.
    """
    from ..sources.dataset import load_info

    base, faults = local(root), []
    info = load_info(root)
    data = [os.path.join(at, n) for at, _, names in os.walk(os.path.join(base, "data")) for n in names if n.endswith(".parquet")]
    if not data:
        faults.append("no data files")
    faults += [f"empty {os.path.relpath(p, base)}" for p in sorted(data) if not os.path.getsize(p)]
    owned = keys_of(info.features, "image") if external_videos else keys_of(info.features, "image", "video")
    if owned:
        have = json.loads(open(os.path.join(base, L.STATS)).read()) if os.path.exists(os.path.join(base, L.STATS)) else {}
        faults += [f"no statistics of {k}" for k in owned if k not in have]
    for key in keys_of(info.features, "video"):
        there = [os.path.join(at, n) for at, _, names in os.walk(os.path.join(base, "videos")) for n in names if n.endswith(".mp4") and f"/{key}" in at]
        if not there:
            faults.append(f"no videos of {key}")
        faults += [f"empty {os.path.relpath(p, base)}" for p in sorted(there) if not os.path.getsize(p)]
    return faults
