"""Assigning episodes to files by size.

A file is closed before an episode that would fill it (if it holds any), when
it has enough episodes, or after an episode that filled it: a running sum that
is reset.  The fold reads its rows in order and keeps three numbers, so a group
of any length passes through one task in constant memory; the rows are those of
episodes, not of frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def rotate(rows: DataFrame, order: Sequence[str], size: str, limit: float, *, group: Sequence[str] = (), most: int = 0, after: bool = True, name: str = "file") -> DataFrame:
    """Adds ``name``, the ordinal of the file in its group, from 0.

    ``most`` episodes at most are in a file (0: no such limit); ``after`` also
    closes a file that has reached the limit.  Null sizes are 0.
    """
    group, order = list(group), list(order)
    names = rows.columns
    at = {n: i for i, n in enumerate(names)}
    ordered = (rows.repartition(*group) if group else rows.repartition(1)).sortWithinPartitions(*group, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    plain = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema)], T.StructField("file", T.LongType())])
    arrow = to_arrow_schema(plain)
    ordered = ordered.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, held, file = None, 0.0, 0, 0
        for b in batches:
            keys = list(zip(*(b.column(at[g]).to_pylist() for g in group))) if group else [()] * b.num_rows
            out = []
            for k, s in zip(keys, b.column(at[size]).to_pylist()):
                s = float(s or 0.0)
                if k != key:
                    key, used, held, file = k, 0.0, 0, 0
                elif held and (used + s >= limit or (most and held >= most)):
                    used, held, file = 0.0, 0, file + 1
                out.append(file)
                used, held = used + s, held + 1
                if after and used >= limit:
                    used, held, file = 0.0, 0, file + 1
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(arrow.field(i).type) for i in range(b.num_columns)], pa.array(out, pa.int64())], schema=arrow)

    return ordered.mapInArrow(fold, plain).toDF(*schema.names)


def places(rows: DataFrame, chunks_size: int, file: str = "file") -> DataFrame:
    """Adds chunk_index and file_index of a file's ordinal."""
    size = chunks_size if chunks_size > 0 else 1000
    return rows.withColumn("chunk_index", F.floor(F.col(file) / size).cast("bigint")).withColumn("file_index", (F.col(file) % size).cast("bigint"))


def media_offsets(rows: DataFrame, group: Sequence[str], order: str, duration: str, file: str = "file") -> DataFrame:
    """Adds from_timestamp and to_timestamp, the running time in the file."""
    w = Window.partitionBy(*group, file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("to_timestamp", F.sum(duration).over(w)).withColumn("from_timestamp", F.col("to_timestamp") - F.col(duration))
