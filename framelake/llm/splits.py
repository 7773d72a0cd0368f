"""Train, validation and test splits that keep linked records together.

Records that share an id, or of which one was made from the other, form a
component; a component lies in one split.  Components are kept in a table that
is carried from run to run: new links are mapped to the components of their
ends, contracted inside each task, and then over all tasks by hooking every
component to its smallest neighbour, with pointer jumping to the roots.  A component that already had a split keeps it, a
new one fills the largest deficit against the wanted shares, and a component
that joins records of different splits is quarantined, and stays so.  The ids
are carried too, so a run may be given new records alone.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.common import BROADCAST_ROWS, lookup_join, materialize
from ..sources.files import local

#: Written forms of an id that is not known; they link nothing.
UNKNOWN_IDS = ("", "unknown", "n/a", "-")
#: Edges that a task contracts at a time.
CHUNK = 1 << 20
#: A component of at least 1/HEAVY of its home's weight is placed one by one.
HEAVY = 64
BUCKETS = 256
SPLITS = ("train", "val", "test")
QUARANTINE = "quarantine"
#: Kind of the key of a parent that is no record yet; ids have 0, 1, ...
WAITING = -1


@dataclass
class State:
    """The tables that are carried from run to run.

    nodes: node, component, home, weight, split, status, one row per record.
    keys: kind, key, component, for each id, and for each parent that is awaited
    (several components may await the same one; that does not link them).
    """

    nodes: DataFrame
    keys: DataFrame


def clean_id(c: Column) -> Column:
    """An id without letter case and outer white space; null if it is unknown."""
    v = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(~v.isin(*UNKNOWN_IDS), v)


def _held(rows: DataFrame, node: str, ids: Sequence[str]) -> DataFrame:
    """Columns node, kind, key: the known ids of the records."""
    keyed = [F.struct(F.lit(i).alias("kind"), clean_id(F.col(f"`{c}`")).alias("key")) for i, c in enumerate(ids)]
    return rows.select(F.col(node).alias("node"), F.inline(F.array(*keyed))).where(F.col("key").isNotNull()).distinct()


def _children(rows: DataFrame, node: str, parent: str) -> DataFrame:
    return rows.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct()


def _lookup(rows: DataFrame, keys: Sequence[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """Join with a stored table of one row per key, however skewed ``rows`` are:
    by broadcast if its counted rows are few, else with the heavy keys, by their
    counted rows, split off."""
    keys = list(keys)
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    weights = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    used = materialize(table.join(weights, keys))
    total = used.agg(F.sum("__n")).first()[0] or 0
    return lookup_join(rows, used, keys, n_rows=total, weight="__n", how=how)


def _relabel(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``column`` replaced by its root, where ``roots`` (node, root) has one."""
    to = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return _lookup(rows, [column], to, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")


def links(records: DataFrame, node: str, ids: Sequence[str], parent: str | None, earlier: State | None = None) -> DataFrame:
    """Edges (u > v) of records that share an id or are parent and child.

    Every id value is a star around its smallest record, which is found with
    map-side combining; the records of a value that holds a third of all rows
    meet it by broadcast.  Null and unknown ids link nothing, nor does a parent
    that is no record, or the record itself.  With ``earlier`` there are edges to
    the components of earlier records as well: by an id, to a parent, and from a
    parent that was awaited.
    """
    rows = records.where(F.col(node).isNotNull())
    parts = []
    if ids:
        held = _held(rows, node, ids)
        # a value with one record links only with earlier ones
        tops = materialize(held.groupBy("kind", "key").agg(F.min("node").alias("top"), F.max("node").alias("last")))
        shared = tops.where(F.col("top") != F.col("last")).select("kind", "key", "top")
        parts.append(_lookup(held, ["kind", "key"], shared).select(F.col("node").alias("u"), F.col("top").alias("v")))
        if earlier is not None:
            parts.append(tops.join(earlier.keys, ["kind", "key"]).select(F.col("top").alias("u"), F.col("component").alias("v")))
    if parent is not None:
        child = _children(rows, node, parent)
        known = rows.select(F.col(node).alias("parent")).distinct()
        if earlier is not None:
            came = known.select(F.col("parent").alias("u"), F.lit(WAITING).alias("kind"), F.col("parent").cast("string").alias("key"))
            parts.append(came.join(earlier.keys, ["kind", "key"]).select("u", F.col("component").alias("v")))
            known = known.union(earlier.nodes.select("node")).distinct()
        valid = materialize(child.select("parent").distinct().join(known, "parent", "left_semi"))
        parts.append(_lookup(child, ["parent"], valid).select(F.col("node").alias("u"), F.col("parent").alias("v")))
    if not parts:
        return rows.select(F.col(node).alias("u"), F.col(node).alias("v")).limit(0)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return _oriented(edges)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _follow(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Map both ends of the edges to their roots and drop what became a loop."""
    return _oriented(_relabel(_relabel(edges, "v", roots), "u", roots))


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same links as stars: each node with the smallest one it hangs with."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = lo < hi
        if not open_.any():
            break
        np.minimum.at(root, hi[open_], lo[open_])
        while not np.array_equal(up := root[root], root):
            root = up
    hangs = root != np.arange(len(ids))
    return ids[hangs], ids[root[hangs]]


def _contract(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges with the same components, contracted in each task by itself.

    ``chunk`` edges at a time become stars, so memory is bounded; what spans
    chunks and tasks is left to the rounds over all of them.
    """
    schema = edges.select("u", "v").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            u, v = _forest(*(t.column(i).to_numpy() for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u, t.schema.field(0).type), pa.array(v, t.schema.field(1).type)], names=["u", "v"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, schema)


def _jump(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: the root of every hooked node, in log(depth) rounds."""
    hooks = materialize(hooks)
    while True:
        # only nodes that are roots of others and hooked themselves lead further
        q = materialize(hooks.select(F.col("root").alias("node")).distinct().join(hooks, "node"))
        if q.limit(1).count() == 0:
            return hooks
        hooks = materialize(_relabel(hooks, "root", q))


def components(edges: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Columns node, component: the smallest node that is linked with it.

    ``previous`` is an earlier result; its components are merged, not rebuilt:
    only the links given now are followed.  Nodes without a link are absent
    unless they were in ``previous``.  Each round removes every node that has a
    smaller neighbour, so the edges shrink geometrically.
    """
    if previous is not None:
        known = previous.select("node", F.col("component").alias("root"))
        left = materialize(_contract(_follow(edges, known)))
        nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
        new = nodes.join(known, "node", "left_anti").select("node", F.col("node").alias("root"))
        labels = known.unionByName(new)
    else:
        left = materialize(_contract(edges))
        labels = None
    maps = []
    while left.limit(1).count():
        roots = _jump(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        maps.append(roots)
        left = materialize(_contract(_follow(left, roots)))
    if labels is not None:
        for m in maps:
            labels = _relabel(labels, "root", m)
    elif not maps:
        return left.select(F.col("u").alias("node"), F.col("u").alias("component"))
    else:
        # a node is hooked in exactly one round, so the maps are disjoint
        labels = maps[0]
        for m in maps[1:]:
            labels = _relabel(labels, "root", m).unionByName(m)
        labels = materialize(labels)
        labels = labels.unionByName(labels.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root")))
    return labels.select("node", F.col("root").alias("component"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Largest component first, each to the split that lacks most; <= HEAVY rows."""
    pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
    lack = pdf[[f"lack_{s}" for s in SPLITS]].iloc[0].to_numpy(dtype=float).copy()
    chosen = []
    for w in pdf["weight"]:
        i = int(lack.argmax())
        lack[i] -= w
        chosen.append(SPLITS[i])
    return pd.DataFrame({"component": pdf["component"].to_numpy(), "home": pdf["home"].to_numpy(), "weight": pdf["weight"].to_numpy(), "split": chosen})


def assign_splits(members: DataFrame, shares: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Columns component, home, weight, split, status of every component.

    ``members`` has node, component, home and weight, one row per node (a null
    weight is 0); the home of a component is that of most of its weight, the
    smallest at a tie.  ``shares`` has home, train, val and test; a home that
    is absent has 0.8, 0.1 and 0.1.  ``previous`` has node and split; a component
    with a quarantined record is quarantined.  status is kept, quarantined or new.
    """
    m = members.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("double"))
    per_home = m.groupBy("component", "home").agg(F.sum("weight").alias("w"))
    best = per_home.groupBy("component").agg(F.max(F.struct("w", F.col("home"))).alias("b"), F.sum("w").alias("weight"))
    comps = best.select("component", F.col("b.home").alias("home"), "weight")
    if previous is not None:
        old = (
            m.select("node", "component").join(previous.select("node", "split"), "node")
            .groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        )
        comps = comps.join(old, "component", "left")
    else:
        comps = comps.withColumn("lo", F.lit(None).cast("string")).withColumn("hi", F.lit(None).cast("string"))
    comps = materialize(comps.withColumn("status", F.when(F.col("lo").isNull(), "new").when((F.col("lo") != F.col("hi")) | (F.col("lo") == QUARANTINE), "quarantined").otherwise("kept")))
    held = [F.sum(F.when((F.col("status") == "kept") & (F.col("lo") == s), F.col("weight")).otherwise(0.0)).alias(f"held_{s}") for s in SPLITS]
    usable = F.col("status") != "quarantined"
    homes = comps.where(usable).groupBy("home").agg(F.sum("weight").alias("total"), *held)
    want = shares.select(F.col("home").alias("h"), *SPLITS)
    homes = homes.join(want, F.col("home").eqNullSafe(F.col("h")), "left").select(
        "home", "total",
        *[(F.coalesce(F.col(s), F.lit(d)) * F.col("total") - F.col(f"held_{s}")).alias(f"lack_{s}") for s, d in zip(SPLITS, (0.8, 0.1, 0.1))],
    )
    homes = materialize(homes)
    few = homes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(homes) if few else homes
    fresh = comps.where(F.col("status") == "new").select("component", "home", "weight").alias("c").join(
        side.alias("t"), F.col("c.home").eqNullSafe(F.col("t.home"))
    ).select("c.*", "t.total", *[f"t.lack_{s}" for s in SPLITS])
    heavy = fresh.where(F.col("weight") * HEAVY >= F.col("total"))
    schema = fresh.select("component", "home", "weight").schema.simpleString()[7:-1] + ",split:string"
    placed = materialize(heavy.groupBy("home").applyInPandas(_greedy, schema))
    used = placed.groupBy("home").agg(*[F.sum(F.when(F.col("split") == s, F.col("weight")).otherwise(0.0)).alias(f"used_{s}") for s in SPLITS])
    used = used.withColumnRenamed("home", "uh")
    rest = fresh.where(F.col("weight") * HEAVY < F.col("total")).join(
        F.broadcast(used) if few else used, F.col("home").eqNullSafe(F.col("uh")), "left"
    ).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)))
    lack = [F.greatest(F.lit(0.0), F.col(f"lack_{s}") - F.coalesce(F.col(f"used_{s}"), F.lit(0.0))) for s in SPLITS]
    # position of a component on the line of all light ones of its home, by two
    # levels of running sums: over the buckets, then inside a bucket
    sums = rest.groupBy("home", "bucket").agg(F.sum("weight").alias("bw"))
    over = Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("home").alias("bh"), F.col("bucket").alias("bb"), (F.sum("bw").over(over) - F.col("bw")).alias("before"), F.sum("bw").over(Window.partitionBy("home")).alias("line"))
    inside = Window.partitionBy("home", "bucket").orderBy(F.xxhash64("component"), "component").rowsBetween(Window.unboundedPreceding, 0)
    placed_rest = (
        rest.withColumn("upto", F.sum("weight").over(inside))
        .join(sums, F.col("home").eqNullSafe(F.col("bh")) & (F.col("bucket") == F.col("bb")))
        .withColumn("at", F.when(F.col("line") > 0, (F.col("before") + F.col("upto") - F.col("weight") / 2) / F.col("line")).otherwise((F.col("bucket") + 0.5) / BUCKETS))
        .withColumn("a", lack[0]).withColumn("b", lack[1]).withColumn("c", lack[2])
        .withColumn("s", F.col("a") + F.col("b") + F.col("c"))
        .withColumn("split", F.when((F.col("s") <= 0) | (F.col("at") * F.col("s") < F.col("a")), SPLITS[0]).when(F.col("at") * F.col("s") < F.col("a") + F.col("b"), SPLITS[1]).when(F.col("c") > 0, SPLITS[2]).otherwise(SPLITS[0]))
        .select("component", "home", "weight", "split")
    )
    kept = comps.where(F.col("status") != "new").select("component", "home", "weight", F.when(F.col("status") == "kept", F.col("lo")).otherwise(QUARANTINE).alias("split"), "status")
    return placed.unionByName(placed_rest).withColumn("status", F.lit("new")).unionByName(kept)


def split_records(
    records: DataFrame, node: str, ids: Sequence[str], parent: str | None, home: str, weight: str, shares: DataFrame,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Columns node, component, split, status for every distinct record.

    ``previous`` is an earlier result (node, component, split).  It has no ids,
    so ``records`` must be all there are; ``update_splits`` takes new ones alone.
    Records that are stored several times count once.  An empty table gives no
    rows.
    """
    edges = links(records, node, ids, parent)
    found = components(edges, None if previous is None else previous.select("node", "component"))
    nodes = records.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(home).alias("home"), F.max(weight).alias("weight"))
    members = materialize(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    comps = materialize(assign_splits(members, shares, None if previous is None else previous.select("node", "split")))
    return _lookup(members.select("node", "component"), ["component"], comps.select("component", "split", "status")).select("node", "component", "split", "status")


def update_splits(
    records: DataFrame, node: str, ids: Sequence[str], parent: str | None, home: str, weight: str, shares: DataFrame,
    previous: State | None = None,
) -> State:
    """The tables after a batch, with all records of it and of earlier ones.

    A record that comes again may bring further ids; ids it had stay linked.
    """
    rows = records.where(F.col(node).isNotNull())
    found = components(links(records, node, ids, parent, previous), None if previous is None else previous.nodes.select("node", "component"))
    every = rows.select(F.col(node).alias("node"), F.col(home).alias("home"), F.col(weight).alias("weight"))
    if previous is not None:
        every = every.unionByName(previous.nodes.select("node", "home", "weight"))
    nodes = every.groupBy("node").agg(F.min("home").alias("home"), F.max("weight").alias("weight"))
    members = materialize(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    comps = materialize(assign_splits(members, shares, None if previous is None else previous.nodes.select("node", "split")))
    table = _lookup(members, ["component"], comps.select("component", "split", "status")).select("node", "component", "home", "weight", "split", "status")
    where = members.select("node", "component")
    keys = where.select("component", F.lit(WAITING).alias("kind"), F.lit("").alias("key")).limit(0)
    if ids:
        keys = keys.unionByName(_held(rows, node, ids).join(where, "node").drop("node"))
    if parent is not None:
        keys = keys.unionByName(_children(rows, node, parent).join(where, "node").select("component", F.lit(WAITING).alias("kind"), F.col("parent").cast("string").alias("key")))
    if previous is not None:
        # only components that were merged into others have another name now
        merged = materialize(previous.nodes.select(F.col("component").alias("node")).distinct().join(where, "node").where(F.col("node") != F.col("component")).select("node", F.col("component").alias("root")))
        keys = keys.unionByName(_relabel(previous.keys, "component", merged))
    there = nodes.select(F.lit(WAITING).alias("kind"), F.col("node").cast("string").alias("key"))
    return State(table, keys.distinct().join(there, ["kind", "key"], "left_anti").select("kind", "key", "component"))


def _runs(root: str) -> list[str]:
    """Complete runs under ``root``, in order; nodes are written last."""
    base = local(root)
    return sorted(n for n in (os.listdir(base) if os.path.isdir(base) else []) if os.path.exists(os.path.join(base, n, "nodes", "_SUCCESS")))


def write_state(state: State, root: str) -> State:
    """Writes the tables as the next run under ``root``, a folder that all
    executors share, and gives them as they are there."""
    runs = _runs(root)
    at = os.path.join(root, f"{int(runs[-1]) + 1 if runs else 0:06d}")
    state.keys.write.mode("overwrite").parquet(f"{at}/keys")
    state.nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    return read_state(state.nodes.sparkSession, root)


def read_state(spark: SparkSession, root: str) -> State | None:
    """The tables of the last complete run; None before the first."""
    runs = _runs(root)
    if not runs:
        return None
    at = os.path.join(root, runs[-1])
    return State(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/keys"))


def shares_of(info: DataFrame, home: str, splits: str) -> DataFrame:
    """Shares train, val and test of each home from its JSON of index ranges.

    A range that is unreadable counts as empty; without any usable range the
    shares are 0.8, 0.1 and 0.1.
    """
    m = F.from_json(F.col(splits), "map<string,string>")

    def length(s: str) -> Column:
        r = F.split(m[s], ":")
        return F.coalesce(F.greatest(F.lit(0.0), F.try_element_at(r, F.lit(2)).try_cast("double") - F.try_element_at(r, F.lit(1)).try_cast("double")), F.lit(0.0))

    rows = info.groupBy(F.col(home).alias("home")).agg(F.max(splits).alias(splits)).select("home", *[length(s).alias(s) for s in SPLITS])
    total = F.col("train") + F.col("val") + F.col("test")
    return rows.select("home", *[F.when(total > 0, F.col(s) / total).otherwise(F.lit(d)).alias(s) for s, d in zip(SPLITS, (0.8, 0.1, 0.1))])
