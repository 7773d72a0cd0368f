"""Filling fixed-capacity containers by balanced cost.

Items of a group are placed in descending size, each into the container of the
lowest cost (linear plus quadratic in its length) that still has room, of as
many containers as best fit needs for the same items.  An item above the capacity is
divided into full containers and a remainder.  A group may hold any part of all
rows: it is packed in blocks of bounded size, and the containers that blocks
leave partly empty are packed once more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.common import materialize

BLOCK = 20_000
#: Containers of a divided group that are less full than this are packed again.
FULL = 0.97
_EPS = 1e-9


def _place(sizes: np.ndarray, costs: np.ndarray, capacity: float, start: int, balanced: bool) -> tuple[np.ndarray, int]:
    """Container of each item, and how many there are.

    Items go in descending order into the container of the lowest cost that has
    room (``balanced``), or into the one with the least room that suffices.
    """
    n, k = len(sizes), start
    out, room, load = np.full(n, -1, dtype=np.int64), np.zeros(n + start), np.zeros(n + start)
    room[:k] = capacity
    for i in np.lexsort((np.arange(n), -costs, -sizes)):
        fit = np.flatnonzero(room[:k] >= sizes[i] - _EPS)
        if len(fit):
            b = fit[np.argmin(load[fit] if balanced else room[fit])]
        else:
            b = k
            room[b] = capacity
            k += 1
        out[i] = b
        room[b] -= sizes[i]
        load[b] += costs[i]
    return out, k


def pack_sizes(sizes: np.ndarray, costs: np.ndarray, capacity: float) -> np.ndarray:
    """Container number of each item; no size may exceed the capacity.

    Costs are balanced over as many containers as best fit needs.  Where the
    balance would need more, as with items of a third of the capacity and more,
    the items stay where best fit put them: room counts before balance.
    """
    if not len(sizes):
        return np.empty(0, dtype=np.int64)
    tight, least = _place(sizes, costs, capacity, 0, False)
    even, used = _place(sizes, costs, capacity, least, True)
    out = even if used <= least else tight
    return np.unique(out, return_inverse=True)[1].astype(np.int64)


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
    whole = pdf["size"].to_numpy(dtype=float)
    pdf["local"] = pack_sizes(whole, pdf["cost"].to_numpy(dtype=float), float(pdf["capacity"].iloc[0]))
    fill = pdf.groupby("local")["size"].transform("sum")
    pdf["fill"] = fill / pdf["capacity"]
    return pdf[["grp", "kind", "block", "item", "piece", "n_pieces", "size", "cost", "capacity", "local", "fill"]]


_SCHEMA = "grp string, kind string, block bigint, item bigint, piece bigint, n_pieces bigint, size double, cost double, capacity double, local bigint, fill double"


def pieces(items: DataFrame) -> DataFrame:
    """Items (grp, kind, item, size, length, capacity) as pieces that fit.

    A size that is null, NaN, infinite or not positive takes no room.  An item
    above the capacity becomes full pieces and a remainder.  Cost is the length
    plus the square of the length over 1000; a piece costs its share.
    """
    known = F.col("size").isNotNull() & ~F.isnan("size") & (F.col("size") > 0) & (F.col("size") < float("inf"))
    size = F.when(known, F.col("size")).otherwise(0.0).cast("double")
    length = F.greatest(F.coalesce(F.col("length"), F.lit(0)).cast("double"), F.lit(0.0))
    rows = items.select("grp", "kind", "item", size.alias("whole"), (length + length * length / 1000.0).alias("c"), F.col("capacity").cast("double").alias("capacity"))
    full = F.floor(F.col("whole") / F.col("capacity")).cast("bigint")
    rest = F.col("whole") - full * F.col("capacity")
    rows = rows.withColumn("full", full).withColumn("rest", rest)
    n = F.when((F.col("full") > 0) & (F.col("rest") <= _EPS), F.col("full")).otherwise(F.col("full") + 1)
    rows = rows.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
    part = F.when(F.col("piece") < F.col("full"), F.col("capacity")).otherwise(F.col("rest"))
    return rows.select("grp", "kind", "item", "piece", "n_pieces", part.alias("size"), F.when(F.col("whole") > 0, F.col("c") * part / F.col("whole")).otherwise(F.col("c")).alias("cost"), "capacity")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Number the blocks of each group so that none holds much over ``block``."""
    counts = materialize(rows.groupBy("grp", "kind").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block))).cast("bigint").alias("blocks")))
    many = counts.where(F.col("blocks") > 1)  # at most one such group per `block` rows
    if many.limit(1).count() == 0:
        return rows.withColumn("block", F.lit(0).cast("bigint"))
    side = F.broadcast(many.select(F.col("grp").alias("g2"), F.col("kind").alias("k2"), "blocks"))
    joined = rows.join(side, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("kind") == F.col("k2")), "left")
    block_of = F.pmod(F.xxhash64("item", "piece"), F.coalesce("blocks", F.lit(1)).cast("bigint"))
    return joined.withColumn("block", block_of).drop("g2", "k2", "blocks")


def pack(items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Columns grp, kind, container, item, piece, n_pieces, size, capacity, fill.

    ``items`` has grp (string), kind (string), item (bigint), size, length and
    capacity (positive, the same within grp and kind), each item once per kind.
    Containers of a group and kind are numbered from 0.  An empty table gives
    no rows.
    """
    cut = pieces(items)
    first = materialize(_blocks(cut, block).groupBy("grp", "kind", "block").applyInPandas(_pack_block, _SCHEMA))
    split = first.where(F.col("block") > 0).select("grp", "kind").distinct().withColumn("divided", F.lit(True))
    if split.limit(1).count():
        sg = split.select(F.col("grp").alias("g2"), F.col("kind").alias("k2"), "divided")
        first = first.join(F.broadcast(sg), F.col("grp").eqNullSafe(F.col("g2")) & (F.col("kind") == F.col("k2")), "left").drop("g2", "k2")
        loose = F.coalesce("divided", F.lit(False)) & (F.col("fill") < FULL)
        again = _blocks(first.where(loose).drop("block", "local", "fill", "divided"), block)
        again = again.groupBy("grp", "kind", "block").applyInPandas(_pack_block, _SCHEMA).withColumn("block", -F.col("block") - 1)
        first = materialize(first.where(~loose).drop("divided").unionByName(again))
    made = first.select("grp", "kind", "block", "local").distinct()
    used = made.groupBy("grp", "kind", "block").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("grp", "kind").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    start = used.select(F.col("grp").alias("g2"), F.col("kind").alias("k2"), F.col("block").alias("b2"), (F.sum("c").over(over) - F.col("c")).alias("before"))
    place = made.withColumn("at", F.row_number().over(Window.partitionBy("grp", "kind", "block").orderBy("local")) - 1)
    same = F.col("grp").eqNullSafe(F.col("g2")) & (F.col("kind") == F.col("k2")) & (F.col("block") == F.col("b2"))
    named = place.join(start, same).select(
        F.col("grp").alias("g3"), F.col("kind").alias("k3"), F.col("block").alias("b3"), F.col("local").alias("l3"), (F.col("before") + F.col("at")).cast("bigint").alias("container")
    )
    same = F.col("grp").eqNullSafe(F.col("g3")) & (F.col("kind") == F.col("k3")) & (F.col("block") == F.col("b3")) & (F.col("local") == F.col("l3"))
    return first.join(named, same).select("grp", "kind", "container", "item", "piece", "n_pieces", "size", "capacity", "fill")
