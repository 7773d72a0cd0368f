"""Listings and footers of files, read in parallel."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local(path: str) -> str:
    """A path that Python can open; all executors must see it."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Columns path (relative) and length of all files under ``root``."""
    base = os.path.abspath(local(root))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.col("path"), F.lit(r"^.*?" + _quote(base) + "/"), F.lit(""))
    return files.select(relative.alias("path"), "length")


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Columns path, n_rows, uncompressed_mb, file_mb from parquet footers."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            out: list[list] = [[], [], [], []]
            for p in b.column(0).to_pylist():
                m = pq.read_metadata(local(p))
                size = sum(m.row_group(g).column(c).total_uncompressed_size for g in range(m.num_row_groups) for c in range(m.num_columns))
                for c, v in zip(out, (p, m.num_rows, size / 2**20, os.path.getsize(local(p)) / 2**20)):
                    c.append(v)
            yield pa.RecordBatch.from_pydict({"path": pa.array(out[0], pa.string()), "n_rows": pa.array(out[1], pa.int64()), "uncompressed_mb": pa.array(out[2], pa.float64()), "file_mb": pa.array(out[3], pa.float64())})

    return listed.mapInArrow(read, "path string, n_rows bigint, uncompressed_mb double, file_mb double")


def normalise_images(frames: DataFrame, images: Sequence[str]) -> DataFrame:
    """Image cells as struct<bytes, path string>, whatever type path has."""
    for c in images:
        q = F.col(f"`{c}`")
        cell = F.when(q.isNotNull(), F.struct(q["bytes"].alias("bytes"), q["path"].cast("string").alias("path")))
        frames = frames.withColumn(c, cell)
    return frames
