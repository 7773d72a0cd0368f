"""Helpers shared by the operators: durable materialisation and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this fraction of all rows: there are at
#: most ``HEAVY_PARTS`` such keys however large the input is, so that a table
#: of heavy keys may always be broadcast.
HEAVY_PARTS = 512

#: A lookup table is broadcast only if its rows were counted and are at most
#: this many; above it the join is a shuffle join with the heavy keys split off.
BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table written in the shared folder.

    Unlike a checkpoint it is kept in columns, so that what reads it later takes
    only the columns it needs.  The table goes when the session ends.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def partitions_for(df: DataFrame, target: int = 32 << 20) -> int:
    """Partitions of an explicit shuffle of ``df``: the session's number, or
    more where the planner's estimate of its size asks for more than that."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, TypeError):  # a session without a local planner
        return least
    if size >= 1 << 50:  # the planner does not know it
        return least
    return max(least, min(100_000, -(-size // target)))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    n_rows: int,
    weight: str,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many ``rows`` with a ``lookup`` that has one row per key.

    ``weight`` names the lookup's column with the number of rows of each key
    and ``n_rows`` is the number of all rows.  The lookup is broadcast if its
    counted rows are few.  Otherwise the heavy keys, at most ``HEAVY_PARTS``,
    are broadcast and their rows never shuffled; the rest is a shuffle join in
    which no key has more than ``1/HEAVY_PARTS`` of the rows.  Null keys match
    nothing.  ``lookup`` should be materialised: it is read up to three times.
    """
    keys = list(keys)
    plain = lookup.drop(weight)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(plain), keys, how)
    heavy = lookup.where(F.col(weight) >= F.lit(max(1, n_rows // HEAVY_PARTS)))
    light = lookup.where(F.col(weight) < F.lit(max(1, n_rows // HEAVY_PARTS))).drop(weight)
    heavy_plain = F.broadcast(heavy.drop(weight))
    hot = rows.join(heavy_plain, keys, "inner")
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(cold)
