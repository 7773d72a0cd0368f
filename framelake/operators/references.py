"""References to records that do not exist.

Orphans are found without shuffling the referring rows by their (skewed) keys:
references are counted per key and period, which combines on the map side.  Of
these counts, those of heavy keys are checked against the targets by broadcast
and those of the remaining keys by a shuffle join; both give the *suspect*
groups of references: keys that are missing, deleted, or later than the first
reference of the period.  The rows of suspect groups, and only those, are read
again, because copies of a row count once and only some rows of a group may be
earlier than their target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_PARTS, lookup_join, materialize

MISSING, DELETED, LATE = "missing", "deleted", "late"


def target_status(
    targets: DataFrame, keys: Sequence[str], *, available_at: str | None, deleted_at: str | None
) -> DataFrame:
    """One row per target key: is it deleted, and since when is it there.

    A key stored several times is deleted only if all its copies are, and is
    available from the first of its copies that count.  Null keys are no target.
    """
    gone = F.col(deleted_at).isNotNull() if deleted_at else F.lit(False)
    seen = F.col(available_at) if available_at else F.lit(None).cast("timestamp_ntz")
    named = targets.select(*[F.col(f"`{k}`") for k in keys], gone.alias("__gone"), seen.alias("__seen"))
    return (
        named.dropna(subset=[f"`{k}`" for k in keys])
        .groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(
            F.min("__gone").alias("__deleted"),
            F.min(F.when(~F.col("__gone"), F.col("__seen"))).alias("__live_from"),
            F.min("__seen").alias("__any_from"),
        )
        .select(
            *[F.col(f"`{k}`") for k in keys],
            "__deleted",
            F.coalesce("__live_from", "__any_from").alias("__available"),
            F.lit(True).alias("__present"),
        )
    )


def reference_profile(refs: DataFrame, keys: Sequence[str], seen: str) -> DataFrame:
    """References per key and ``__period``: how many, and the earliest of them."""
    return refs.groupBy(*[F.col(f"`{k}`") for k in keys], "__period").agg(
        F.count(F.lit(1)).alias("__n"), F.min(seen).alias("__first_seen")
    )


def _checked(profile: DataFrame, targets: DataFrame, keys: list[str], n_rows: int, *, available_at: str | None, deleted_at: str | None) -> DataFrame:
    """The profile with what its keys find among the targets.

    A key with at least ``1/HEAVY_PARTS`` of all references is heavy, so there
    are at most ``HEAVY_PARTS`` of them: they go to the targets by broadcast and
    neither they nor the targets are shuffled for them.  The others meet the
    targets in a shuffle join by key, where each has a row for each period only.
    """
    cols = [F.col(f"`{k}`") for k in keys]
    weight = profile.groupBy(*cols).agg(F.sum("__n").alias("__w"))
    heavy = materialize(weight.where(F.col("__w") >= F.lit(max(1, n_rows // HEAVY_PARTS))).select(*cols))
    hot = F.broadcast(heavy)
    status = {"available_at": available_at, "deleted_at": deleted_at}
    heavy_status = target_status(targets.join(hot, keys, "left_semi"), keys, **status)
    heavy_found = profile.join(hot, keys, "left_semi").join(F.broadcast(heavy_status), keys, "left")
    light_found = profile.join(hot, keys, "left_anti").join(target_status(targets, keys, **status), keys, "left")
    return heavy_found.unionByName(light_found)


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    *,
    seen: str,
    period: Column | None = None,
    available_at: str | None = "ingested_at",
    deleted_at: str | None = "deleted_at",
) -> DataFrame:
    """Rows of ``refs`` whose key has no valid target, with a ``reason``.

    ``refs`` and ``targets`` share the key columns; several fields of one table
    are checked in the same scan if the field's name is one of the keys.  The
    reason is the first that holds of ``missing`` (no such key; a reference with
    a null part in a composite key matches none), ``deleted`` (the target is
    marked deleted) and ``late`` (the target arrived after the referring row's
    ``seen``).  A null ``seen`` or arrival is never late.  ``period`` groups the
    references that are counted together.  A column ``reason`` of ``refs`` is
    replaced.  Empty tables give no rows, or every reference as missing.
    Repeated rows come out as often as they went in.
    """
    keys = list(keys)
    refs = refs.drop("reason")
    names = refs.columns
    q = [F.col(f"`{k}`") for k in keys]
    has_null = F.lit(False)
    for c in q:
        has_null = has_null | c.isNull()
    # a hash has no nulls, and periods that share one are merely counted together
    named = refs.where(~has_null).withColumn("__period", F.hash(F.lit(0) if period is None else period))
    profile = materialize(reference_profile(named, keys, seen))
    n_rows = profile.agg(F.sum("__n")).first()[0] or 0
    found = _checked(profile, targets, keys, n_rows, available_at=available_at, deleted_at=deleted_at)
    suspects = materialize(
        found.where(F.col("__present").isNull() | F.col("__deleted") | (F.col("__available") > F.col("__first_seen")))
        .select(*q, "__period", "__n", "__present", "__deleted", "__available")
    )
    hit = lookup_join(named, suspects, [*keys, "__period"], n_rows=n_rows, weight="__n")
    reason = (
        F.when(F.col("__present").isNull(), MISSING)
        .when(F.col("__deleted"), DELETED)
        .when(F.col("__available") > F.col(seen), LATE)
    )
    orphans = (
        hit.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*[F.col(f"`{c}`") for c in names], "reason")
    )
    if len(keys) == 1:
        return orphans
    partial = refs.where(has_null).withColumn("reason", F.lit(MISSING))
    return orphans.unionByName(partial)


def orphan_counts(orphans: DataFrame, row_key: str, by: Sequence[str]) -> DataFrame:
    """Distinct orphan references per ``by`` columns, combined on the map side
    first per row and then per group, so that a large group is no single task."""
    return (
        orphans.select(*by, row_key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    )
