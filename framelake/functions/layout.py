"""Places of the files of a dataset, and its description."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import Features, FeatureSpec, with_defaults

V21, V30 = "v2.1", "v3.0"
#: Names and limits of the two layouts.
ALIASES = {"v2.1": V21, "v2": V21, "2.1": V21, "v3.0": V30, "v3": V30, "3.0": V30}
CHUNKS_SIZE, DATA_MB, VIDEO_MB = 1000, 100, 200
DATA_PATH = {
    V21: "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet",
    V30: "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet",
}
VIDEO_PATH = {
    V21: "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4",
    V30: "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4",
}
EPISODES_PATH = "meta/episodes/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
INFO, STATS, TASKS = "meta/info.json", "meta/stats.json", "meta/tasks.parquet"
OLD_EPISODES, OLD_TASKS, OLD_STATS = "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/episodes_stats.jsonl"


def parse_version(text: str) -> str:
    """A version by any of its aliases, without case and outer space."""
    v = ALIASES.get(text.strip().lower())
    if v is None:
        raise ValueError(f"unknown version {text!r}")
    return v


def fill(template: str, **values: object) -> str:
    """Expand ``{name}`` and ``{name:06d}``; unknown names stay as they are."""

    def put(m: re.Match) -> str:
        name, width = m[1], m[2]
        if name not in values:
            return m[0]
        return f"{int(values[name]):0{int(width)}d}" if width else str(values[name])

    return re.sub(r"\{(\w+)(?::0?(\d+)d)?\}", put, template)


def chunk_of(ordinal: Column, chunks_size: int = CHUNKS_SIZE) -> Column:
    return F.floor(ordinal / F.lit(chunks_size if chunks_size > 0 else CHUNKS_SIZE)).cast("bigint")


def file_of(ordinal: Column, chunks_size: int = CHUNKS_SIZE) -> Column:
    return (ordinal % F.lit(chunks_size if chunks_size > 0 else CHUNKS_SIZE)).cast("bigint")


def path_column(template: str, **values: Column) -> Column:
    """``fill`` as a column expression."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::0?(\d+)d)?\}", template):
        if m[1] not in values:
            continue
        parts.append(F.lit(template[at : m.start()]))
        text = values[m[1]].cast("string")
        parts.append(F.lpad(text, F.greatest(F.length(text), F.lit(int(m[2]))), F.lit("0")) if m[2] else text)
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass
class DatasetInfo:
    """What ``meta/info.json`` says."""

    codebase_version: str
    fps: int
    features: Features
    total_episodes: int = 0
    total_frames: int = 0
    total_tasks: int = 0
    chunks_size: int = CHUNKS_SIZE
    data_files_size_in_mb: int = DATA_MB
    video_files_size_in_mb: int = VIDEO_MB
    data_path: str = ""
    video_path: str | None = None
    robot_type: str | None = None
    splits: dict[str, str] = field(default_factory=dict)
    total_chunks: int | None = None
    total_videos: int | None = None

    @classmethod
    def new(cls, version: str, fps: int, features: Features, *, robot_type: str | None = None, **limits: int) -> DatasetInfo:
        version = parse_version(version)
        merged = with_defaults(features)
        videos = any(v.dtype == "video" for v in merged.values())
        return cls(
            version, fps, merged, data_path=DATA_PATH[version], video_path=VIDEO_PATH[version] if videos else None, robot_type=robot_type or None,
            total_chunks=0 if version == V21 else None, total_videos=0 if version == V21 else None, **limits,
        )

    @classmethod
    def from_json(cls, text: str) -> DatasetInfo:
        d = json.loads(text)
        known = {k: d[k] for k in cls.__dataclass_fields__ if d.get(k) is not None}
        known["features"] = {k: FeatureSpec.of(v) for k, v in d.get("features", {}).items()}
        known.setdefault("fps", 0)
        return cls(**known)

    def to_json(self) -> str:
        """The split of all episodes to train is always written anew."""
        d = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "features"}
        d = {k: v for k, v in d.items() if v is not None}
        d["features"] = {k: v.to_dict() for k, v in self.features.items()}
        d["splits"] = {"train": f"0:{self.total_episodes}"}
        return json.dumps(d, indent=2, sort_keys=True)

    def to_version(self, version: str) -> DatasetInfo:
        version = parse_version(version)
        videos = any(v.dtype == "video" for v in self.features.values())
        return replace(
            self, codebase_version=version, data_path=DATA_PATH[version], video_path=VIDEO_PATH[version] if videos else None,
            total_chunks=0 if version == V21 else None, total_videos=0 if version == V21 else None,
        )

    def episode_path(self, episode: int) -> str:
        size = self.chunks_size if self.chunks_size > 0 else CHUNKS_SIZE
        template = self.data_path if "{" in self.data_path else DATA_PATH[V21]
        return fill(template, episode_chunk=episode // size, episode_index=episode)
