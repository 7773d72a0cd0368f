"""Consolidation of many small files into few well-sized ones.

Steps are read from tiny JSON-lines files, each step is kept once, and the steps
of a repo are clustered on a Hilbert curve over their coordinates, so that a
written file covers a compact region of episodes and frames.  An exact histogram
of bytes per cell of the curve, several cells to a file, gives the borders of
the files, and the files' sizes those of the range shuffle: the rows move once,
to the task that writes their file.  Row digests of source and destination are
compared at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, lookup_join, materialize, partitions_for
from .indexing import running_sum

#: Bits of each coordinate of a code.
BITS = 16
#: Cells of the histogram for each file that a repo needs.
CELLS = 64
#: A cell with more than this part of a file is counted by its codes instead.
FINE = 1 / 32


def _number(variant: Column, path: str) -> Column:
    """An integer however it is written: 7, 7.0, 0.7e1, "7"; null if it is none."""
    exact = F.try_variant_get(variant, path, "string")
    d = F.trim(exact).try_cast("decimal(38,10)")
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def staged_steps(files: DataFrame, *, body: str = "body", keep: tuple[str, ...] = ("file_id", "repo_id", "written_at")) -> DataFrame:
    """One row per line of a staged file that holds a complete JSON object.

    Columns ``keep``, episode_index, frame_index and step, the object's text.
    What surrounds the object in its line is dropped; lines that are cut off,
    empty or without both numbers give nothing, nor do null or empty bodies.
    """
    line = F.explode(F.split(F.col(body), r"\r\n|\n|\r"))
    rows = files.select(*keep, line.alias("line"))
    rows = rows.select(*keep, F.regexp_extract("line", r"\{.*\}", 0).alias("step")).where(F.col("step") != "")
    parsed = rows.withColumn("v", F.try_parse_json("step"))
    found = parsed.select(*keep, _number(F.col("v"), "$.episode_index").alias("episode_index"), _number(F.col("v"), "$.frame_index").alias("frame_index"), "step")
    return found.where(F.col("episode_index").isNotNull() & F.col("frame_index").isNotNull())


def deduplicate_steps(steps: DataFrame, file_key: str, newest: str) -> DataFrame:
    """Each (episode_index, frame_index) once, of the newest file that has it.

    ``several`` tells whether more than one file holds the step.  Copies are
    combined on the map side, so that a step that was staged very often is no
    hot key.  Ties of ``newest`` go to the larger file key, then to the larger
    text.
    """
    best = F.max(F.struct(F.col(newest), F.col(file_key), F.col("step"), F.col("repo_id"))).alias("best")
    kept = steps.groupBy("episode_index", "frame_index").agg((F.min(file_key) != F.max(file_key)).alias("several"), best)
    return kept.select("episode_index", "frame_index", F.coalesce("several", F.lit(False)).alias("several"), F.col("best.repo_id").alias("repo_id"), F.col("best.step").alias("step"))


def hilbert_index(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points with ``bits`` bits a coordinate."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    d = np.zeros_like(x)
    for b in range(bits - 1, -1, -1):
        s = np.int64(1) << b
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * rx.astype(np.int64)) ^ ry.astype(np.int64))
        flip = ~ry & rx
        x = np.where(flip, (s << 1) - 1 - (x & ((s << 1) - 1)), x & ((s << 1) - 1))
        y = np.where(flip, (s << 1) - 1 - (y & ((s << 1) - 1)), y & ((s << 1) - 1))
        x, y = np.where(~ry, y, x), np.where(~ry, x, y)
        x, y = x & (s - 1), y & (s - 1)
    return d


@F.pandas_udf(T.LongType())
def _code(x: pd.Series, y: pd.Series, x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
    def scale(v: pd.Series, lo: pd.Series, hi: pd.Series) -> np.ndarray:
        v, lo, hi = (s.to_numpy(dtype=np.int64) for s in (v, lo, hi))
        span = np.maximum(1, hi - lo)
        narrow = span < (1 << BITS)
        return np.where(narrow, v - lo, ((v - lo).astype(np.float64) * ((1 << BITS) - 1) / span).astype(np.int64))

    return pd.Series(hilbert_index(scale(x, x0, x1), scale(y, y0, y1)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def assign_files(steps: DataFrame, limits: DataFrame, x: str = "episode_index", y: str = "frame_index", *, default_limit_mb: int = 100, default_chunks: int = 1000) -> DataFrame:
    """Adds code, file (ordinal in the repo), chunk_index, file_index and part.

    ``steps`` has repo_id, ``x``, ``y`` (integers) and step, and should be a
    stored table, of which only coordinates and lengths are read to plan.
    ``limits`` has repo_id, limit_mb and chunks_size, of which values that are
    null or not positive mean the defaults.  A repo gets as many files as its
    size needs, filled evenly; a file is a range of the repo's curve, cut
    between two cells of the histogram, and is above the limit only where the
    steps of one code alone are, which are divided by hash.  Sizes are those of
    the steps' text with a line end.  ``part`` numbers the tasks of the range
    shuffle, of equal sizes and each with whole files.  A null repo is one of
    its own; an empty table gives no rows; columns of ``steps`` with the names
    of the added ones are replaced.
    """
    repo = F.when(F.col("repo_id").isNull(), "-").otherwise(F.concat(F.lit("+"), "repo_id")).alias("__repo")
    limit = F.when(F.col("limit_mb") > 0, F.col("limit_mb")).otherwise(default_limit_mb) * F.lit(1 << 20)
    caps = limits.select(repo, limit.alias("cap"), F.when(F.col("chunks_size") > 0, F.col("chunks_size")).otherwise(default_chunks).alias("cs"))
    size = (F.octet_length("step") + 1).cast("bigint")
    keys = steps.select(repo, F.col(x), F.col(y), size.alias("bytes"))
    box = keys.groupBy("__repo").agg(F.sum("bytes").alias("total"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    n_files = F.ceil(F.col("total") * (1 + FINE) / F.coalesce("cap", F.lit(default_limit_mb << 20)))
    level = F.least(F.lit(2 * BITS), F.ceil(F.log2(n_files * CELLS)).cast("int"))
    box = box.join(caps, "__repo", "left").select(
        "__repo", "total", "x0", "x1", "y0", "y1", F.greatest(F.lit(1.0), F.col("total") / n_files).alias("even"), (2 * BITS - level).alias("shift"), F.coalesce("cs", F.lit(default_chunks)).alias("cs")
    )
    side = materialize(_placed_repos(box))  # one row for each repo
    whole = side.agg(F.sum("total")).first()[0] or 1
    side = _small(side)
    coded = lambda rows: rows.join(side, "__repo").withColumn("code", _code(x, y, "x0", "x1", "y0", "y1")).withColumn("cell", F.expr("shiftleft(shiftright(code, shift), shift)"))
    cells = materialize(coded(keys).groupBy("__repo", "cell", "even").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    n_rows = cells.agg(F.sum("n")).first()[0] or 0
    coarse = F.col("bytes") <= F.col("even") * FINE
    heavy = cells.where(~coarse).select("__repo", "cell", F.lit(True).alias("heavy"), "n")
    marked = lambda rows: lookup_join(coded(rows), heavy, ["__repo", "cell"], n_rows=n_rows, weight="n", how="left").withColumn("unit", F.when(F.col("heavy"), F.col("code")).otherwise(F.col("cell")))
    fine = marked(keys).where("heavy").groupBy("__repo", "unit", "even").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    units = cells.where(coarse).select("__repo", F.col("cell").alias("unit"), "even", "bytes", "n").unionByName(fine)
    units = running_sum(units, "unit", "bytes", "upto", group=["__repo"], block=1 << 20)
    first = F.floor((F.col("upto") - F.col("bytes")) / F.col("even") + 1e-9)
    last = F.greatest(first, F.ceil(F.col("upto") / F.col("even") - 1e-9) - 1)
    spread = F.when(F.col("bytes") > F.col("even"), last - first + 1).otherwise(F.lit(1))
    units = materialize(units.select("__repo", "unit", first.alias("first"), spread.alias("spread"), "n"))
    placed = lookup_join(marked(steps.withColumn("__repo", repo)), units, ["__repo", "unit"], n_rows=n_rows, weight="n")
    file = (F.col("first") + F.pmod(F.xxhash64(x, y), F.col("spread"))).cast("bigint")
    parts = partitions_for(steps)
    part = F.least(F.lit(parts - 1), F.floor((F.col("before") + F.col("file") * F.col("even")) * F.lit(parts) / F.lit(whole))).cast("int")
    return placed.withColumn("__file", file).select(
        *[F.col(f"`{c}`") for c in steps.columns if c not in ("code", "file", "chunk_index", "file_index", "part")], "code", F.col("__file").alias("file"), F.floor(F.col("__file") / F.col("cs")).cast("bigint").alias("chunk_index"),
        (F.col("__file") % F.col("cs")).cast("bigint").alias("file_index"), "before", "even",
    ).withColumn("part", part).drop("before", "even")


def _placed_repos(box: DataFrame) -> DataFrame:
    """Adds before, the size of all repos before a repo, in any fixed order: by
    two levels of sums, over buckets and inside them."""
    cut = box.withColumn("__b", F.pmod(F.xxhash64("__repo"), F.lit(1024)))
    sums = cut.groupBy("__b").agg(F.sum("total").alias("t"))
    over = sums.select("__b", (F.sum("t").over(Window.orderBy("__b")) - F.col("t")).alias("__over"))  # 1024 rows
    inner = F.sum("total").over(Window.partitionBy("__b").orderBy("__repo").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    return cut.withColumn("__in", inner).join(over, "__b").withColumn("before", F.col("__in") + F.col("__over")).drop("__b", "__in", "__over")


def range_shuffle(placed: DataFrame, steps: DataFrame) -> DataFrame:
    """The rows in the tasks that ``part`` numbers; every file is in one task."""
    return placed.repartitionById(partitions_for(steps), F.col("part"))


def fill_template(template: Column, chunk: Column, file: Column, ordinal: Column) -> Column:
    """A path from ``{name:0Nd}`` placeholders; a null template gives the default.

    ``episode_chunk`` and ``chunk_index`` are the chunk, ``file_index`` is the
    file in its chunk and ``episode_index`` the ordinal of the file.
    """
    out = F.coalesce(template, F.lit("data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"))
    for name, value in (("chunk_index", chunk), ("episode_chunk", chunk), ("file_index", file), ("episode_index", ordinal)):
        width = F.regexp_extract(out, rf"\{{{name}(?::0?(\d+)d)?\}}", 1)
        text = value.cast("string")
        padded = F.lpad(text, F.greatest(F.length(text), F.coalesce(width.try_cast("int"), F.lit(0))), F.lit("0"))
        out = F.regexp_replace(out, F.lit(rf"\{{{name}(?::0?\d+d)?\}}"), padded)
    return out


def digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Order-free digest of steps: count, bytes, and the sum and xor of hashes."""
    h = F.xxhash64("episode_index", "frame_index", "step")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum(F.octet_length("step") + 1).alias("size_bytes"), F.bit_xor(h).alias("digest_xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("digest_sum")
    )


def write_files(placed: DataFrame, steps: DataFrame, root: str, by: str = "path") -> DataFrame:
    """Writes the steps of each ``path`` to one parquet file under ``root``.

    ``placed`` comes from ``assign_files`` of ``steps``, with a path for each
    file; the range shuffle is the only one.  ``root`` is a folder that all executors share.
    Each file goes to a name of its own first and is renamed when complete, so a
    task that runs twice does no harm.  Gives path, rows written and the range
    of codes.
    """
    ordered = range_shuffle(placed, steps).sortWithinPartitions(by, "code", "episode_index", "frame_index").select(by, "episode_index", "frame_index", "repo_id", "step", "code")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow.parquet as pq

        schema = pa.schema([("episode_index", pa.int64()), ("frame_index", pa.int64()), ("repo_id", pa.string()), ("step", pa.string())])
        writer, at, temp, n, lo, hi, done = None, None, None, 0, 0, 0, []

        def close() -> None:
            if writer is not None:
                writer.close()
                os.replace(temp, os.path.join(root, at))
                done.append((at, n, lo, hi))

        for b in batches:
            keys = b.column(0)
            start = 0
            values = keys.to_pylist()
            while start < len(values):
                end = start
                while end < len(values) and values[end] == values[start]:
                    end += 1
                if values[start] != at:
                    close()
                    at, n, lo = values[start], 0, b.column(5)[start].as_py()
                    full = os.path.join(root, at)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    temp = f"{full}.{uuid.uuid4().hex}.tmp"
                    writer = pq.ParquetWriter(temp, schema, compression="snappy")
                part = b.slice(start, end - start).select(["episode_index", "frame_index", "repo_id", "step"])
                writer.write_table(pa.Table.from_batches([part]).cast(schema))
                n, hi = n + end - start, b.column(5)[end - 1].as_py()
                start = end
        close()
        named = {"path": pa.string(), "n_written": pa.int64(), "first_code": pa.int64(), "last_code": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(named.values())], names=list(named))

    return ordered.mapInArrow(write, "path string, n_written bigint, first_code bigint, last_code bigint")
