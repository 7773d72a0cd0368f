"""Writing datasets with exact file names, types and footers.

Data files are written by one task each with pyarrow, because their names, their
fixed-size lists and their schema metadata are part of the format.  A task
writes to a name of its own and renames at the end; info.json is written last
and makes the dataset visible.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.features import Features, arrow_schema, data_columns, keys_of
from ..operators.common import materialize
from ..operators.stats import STATS, dataset_stats, flatten_stats, sanitise_stats
from .dataset import Dataset
from .files import local

#: Fixed value: rows of a row group in the format's own writer.
ROW_GROUP = 1024
EPISODES_PER_FILE = 100_000


def exact(array: pa.Array, kind: pa.DataType) -> pa.Array:
    """An array of the type on disk; lists become fixed-size lists."""
    if pa.types.is_fixed_size_list(kind):
        n, values = kind.list_size, array.flatten()
        if array.null_count == 0:
            if len(values) != n * len(array):
                raise ValueError(f"a vector has not {n} elements")
            return pa.FixedSizeListArray.from_arrays(exact(values, kind.value_type), n)
        filled = pa.array([[None] * n if v is None else v for v in array.to_pylist()], array.type)
        inner = exact(filled.flatten(), kind.value_type)
        return pa.FixedSizeListArray.from_arrays(inner, n, mask=array.is_null())
    return array if array.type == kind else array.cast(kind)


def write_tables(rows: DataFrame, root: str, path: str, order: list[str], schema: pa.Schema, row_group: int = ROW_GROUP) -> DataFrame:
    """Writes the rows of each ``path`` to one parquet file; gives path, n_rows.

    The rows are shuffled once by path and sorted in their task, so the size of
    a file, which rotation bounds, is what a task holds on disk; memory holds
    one row group.
    """
    base, names = local(root), schema.names
    placed = rows.repartition(F.col(path)).sortWithinPartitions(path, *order)
    # mapInArrow takes no names with dots, so columns go by their place
    placed = placed.select(path, *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        done: list[tuple[str, int]] = []
        at = writer = temp = None
        n, held, size = 0, [], 0

        def flush(all_: bool) -> None:
            nonlocal held, size
            if held and (all_ or size >= row_group):
                writer.write_table(pa.Table.from_batches(held, schema), row_group_size=row_group)
                held, size = [], 0

        def close() -> None:
            if writer is not None:
                flush(True)
                writer.close()
                os.replace(temp, os.path.join(base, at))
                done.append((at, n))

        for b in batches:
            keys = b.column(0).to_pylist()
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != at:
                    close()
                    at, n = keys[start], 0
                    full = os.path.join(base, at)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    temp = f"{full}.{uuid.uuid4().hex}.tmp"
                    writer = pq.ParquetWriter(temp, schema, compression="snappy", use_dictionary=True)
                part = b.slice(start, end - start)
                held.append(pa.RecordBatch.from_arrays([exact(part.column(i + 1), f.type) for i, f in enumerate(schema)], schema=schema))
                n, size = n + end - start, size + end - start
                flush(False)
                start = end
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "n_rows": pa.array([d[1] for d in done], pa.int64())})

    return placed.mapInArrow(write, "path string, n_rows bigint")


def write_data(frames: DataFrame, features: Features, root: str, path: str = "__path") -> int:
    """The data files; ``path`` is the file of each frame.  Gives all rows."""
    wanted = frames
    for c in data_columns(features):
        if c not in frames.columns:
            raise ValueError(f"no column {c!r}")
    return write_tables(wanted, root, path, ["index"], arrow_schema(features)).agg(F.sum("n_rows")).first()[0] or 0


def _dump(root: str, name: str, text: str) -> None:
    full = os.path.join(local(root), name)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    temp = f"{full}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w") as f:
        f.write(text)
    os.replace(temp, full)


def write_info(root: str, info: L.DatasetInfo) -> None:
    _dump(root, L.INFO, info.to_json())


def write_stats(root: str, stats: DataFrame, features: Features) -> None:
    """meta/stats.json from dataset statistics, as many as the schema is wide."""
    out: dict[str, dict] = {}
    for r in sorted(stats.collect(), key=lambda r: (r["feature"], r["dim"])):
        d = out.setdefault(r["feature"], {"count": [r["count"]]})
        for s in STATS:
            v = r[s]
            d.setdefault(s, []).append([[v]] if r["feature"] in features and features[r["feature"]].media else v)
    _dump(root, L.STATS, json.dumps(out, indent=2, sort_keys=True))


def write_tasks(root: str, tasks: DataFrame, version: str) -> None:
    """The dictionary; one row for each distinct task, written in one task."""
    ordered = tasks.select(F.col("task_index").cast("bigint").alias("task_index"), "task")
    if version == L.V21:
        write_lines(ordered, root, L.OLD_TASKS, ["task_index"])
        return
    column = lambda n, t: {"name": n, "field_name": n, "pandas_type": t[0], "numpy_type": t[1], "metadata": None}
    index = {"name": None, "field_name": None, "pandas_type": "unicode", "numpy_type": "object", "metadata": {"encoding": "UTF-8"}}
    note = {"index_columns": ["task"], "column_indexes": [index], "columns": [column("task_index", ("int64", "int64")), column("task", ("unicode", "object"))], "attributes": {}, "pandas_version": "2.3.3"}
    schema = pa.schema([("task_index", pa.int64()), ("task", pa.string())], metadata={b"pandas": json.dumps(note).encode()})
    write_tables(ordered.withColumn("__path", F.lit(L.TASKS)), root, "__path", ["task_index"], schema).collect()


def write_lines(rows: DataFrame, root: str, name: str, order: list[str]) -> None:
    """One file of JSON lines, streamed by one task in order."""
    base = local(root)
    text = rows.select(*order, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("line")).repartition(1).sortWithinPartitions(*order).select("line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = os.path.join(base, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        temp, n = f"{full}.{uuid.uuid4().hex}.tmp", 0
        with open(temp, "w") as f:
            for b in batches:
                for line in b.column(0).to_pylist():
                    f.write(line + "\n")
                    n += 1
        os.replace(temp, full)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    text.mapInArrow(write, "n bigint").collect()


def write_episodes(root: str, episodes: DataFrame, stats: DataFrame | None, version: str) -> None:
    """Episode metadata: parquet with the statistics in columns, or JSON lines."""
    if version == L.V21:
        write_lines(episodes.select("episode_index", "tasks", "length"), root, L.OLD_EPISODES, ["episode_index"])
        if stats is not None:
            ordered = F.array_sort(F.collect_list(F.struct("dim", "count", *STATS)))
            per = stats.groupBy("episode_index", "feature").agg(ordered.alias("v"))
            members = [F.array(F.col("v")[0]["count"]).cast("array<double>").alias("count"), *[F.col("v").getField(s).alias(s) for s in STATS]]
            named = per.select("episode_index", "feature", F.struct(*members).alias("s"))
            maps = named.groupBy("episode_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "s")))).alias("stats"))
            write_lines(episodes.select("episode_index").join(maps, "episode_index", "left").withColumn("stats", F.coalesce("stats", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<count:array<double>," + ",".join(f"{s}:array<double>" for s in STATS) + ">>")))), root, L.OLD_STATS, ["episode_index"])
        return
    wide = episodes
    if stats is not None:
        names = sorted(r[0] for r in stats.select("feature").distinct().collect())  # as many as the schema has
        if names:
            wide = wide.join(flatten_stats(stats, names), "episode_index", "left")
    from pyspark.sql.pandas.types import to_arrow_schema

    number = F.floor(F.col("episode_index") / EPISODES_PER_FILE)
    wide = wide.withColumn("meta/episodes/chunk_index", F.floor(number / L.CHUNKS_SIZE).cast("bigint")).withColumn("meta/episodes/file_index", (number % L.CHUNKS_SIZE).cast("bigint"))
    ordered_cols = sorted(wide.columns)
    wide = wide.select(*[F.col(f"`{c}`") for c in ordered_cols])
    schema = to_arrow_schema(wide.schema)
    path = L.path_column(L.EPISODES_PATH, chunk_index=F.col("`meta/episodes/chunk_index`"), file_index=F.col("`meta/episodes/file_index`"))
    write_tables(wide.withColumn("__path", path), root, "__path", ["episode_index"], schema).collect()


def data_paths(frames: DataFrame, episodes: DataFrame, info: L.DatasetInfo) -> DataFrame:
    """Adds __path, the data file of each frame."""
    from ..operators.indexing import small

    if L.parse_version(info.codebase_version) == L.V21:
        e = F.col("episode_index")
        return frames.withColumn("__path", L.path_column(info.data_path, episode_chunk=L.chunk_of(e, info.chunks_size), episode_index=e))
    place = episodes.select("episode_index", L.path_column(info.data_path, chunk_index=F.col("`data/chunk_index`"), file_index=F.col("`data/file_index`")).alias("__path"))
    return frames.join(small(place), "episode_index")


def with_video_info(info: L.DatasetInfo, root: str) -> L.DatasetInfo:
    """Video features that say nothing of their videos get it from the first."""
    from .media import MediaError, feature_info

    features = dict(info.features)
    for key in keys_of(features, "video"):
        if features[key].info:
            continue
        first = os.path.join(local(root), L.fill(info.video_path, video_key=key, episode_chunk=0, episode_index=0, chunk_index=0, file_index=0))
        try:
            features[key] = replace(features[key], info=feature_info(first, info.fps))
        except (OSError, MediaError, struct.error, IndexError, TypeError):
            continue  # an unreadable video is validation's to report
    return replace(info, features=features)


def write_dataset(dataset: Dataset, root: str) -> Dataset:
    """All files of a dataset, info.json last; gives the dataset as written.

    Statistics that are to be derived are made from the written data files, so
    the plan that made the frames runs once.
    """
    info = dataset.info
    version = L.parse_version(info.codebase_version)
    n = write_data(data_paths(dataset.frames, dataset.episodes, info), info.features, root)
    if n != info.total_frames:
        raise ValueError(f"wrote {n} of {info.total_frames} frames")
    spark = dataset.frames.sparkSession
    written = replace(dataset, root=root)
    if n:
        written.frames = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    if keys_of(info.features, "video"):
        from ..plans.videos import missing, place

        if written.videos is None:
            raise ValueError(f"no videos of {keys_of(info.features, 'video')}")
        lacking = missing(written.videos, written.episodes, keys_of(info.features, "video")).first()
        if lacking is not None:
            raise ValueError(f"episode {lacking[0]}: no video of {lacking[1]}")
        written.episodes, written.videos = place(written.videos, written.episodes, info, root)
        info = written.info = with_video_info(info, root)
    stats = written.long_stats()
    if stats is not None:
        stats = materialize(sanitise_stats(stats))
    write_tasks(root, dataset.tasks, version)
    write_episodes(root, written.episodes, stats, version)
    if stats is not None:
        write_stats(root, dataset_stats(stats), info.features)
    write_info(root, info)
    return replace(written, stats=stats, derive=None, images=())
