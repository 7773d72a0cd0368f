"""Schemas that drift between files and over time.

A schema is a set of fields with a kind.  Schemas are read in parallel from file
headers (parquet footers) or from metadata records (info.json snapshots), folded
through a lattice of type promotions to one schema that holds them all, files
are cast to it, and the differences of successive schemas are logged in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

#: Accepted spellings of the two layout versions.
VERSIONS = {"v2.1": "v2.1", "v2": "v2.1", "2.1": "v2.1", "v3.0": "v3.0", "v3": "v3.0", "3.0": "v3.0"}
#: Top-level fields of which a different value is a change.
VALUE_FIELDS = ("codebase_version", "data_path")
#: Numeric promotions, narrow to wide.
_WIDTH = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "decimal(38,0)": 4, "float": 5, "double": 6}
#: Integers that not every double can tell apart.
_LONG = ("bigint", "decimal(38,0)")


def promote(a: str, b: str) -> str:
    """The least type that holds every value of both: the join of the lattice.

    null is below all types and string above all; numbers widen, and an integer
    of 32 bits and a float meet in double.  Integers of 64 bits and more would
    lose digits in a double, so they meet floats only in string.  A date and a
    time stamp meet in the time stamp; arrays meet by their elements.
    """
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in _WIDTH and b in _WIDTH:
        lo, hi = sorted((a, b), key=_WIDTH.get)
        if hi in ("float", "double") and lo in _LONG:
            return "string"
        return "double" if hi == "float" and lo == "int" else hi
    stamps = {"date", "timestamp", "timestamp_ntz"}
    if a in stamps and b in stamps:
        return "timestamp" if "timestamp" in (a, b) else "timestamp_ntz"
    if a.startswith("array<") and b.startswith("array<"):
        return f"array<{promote(a[6:-1], b[6:-1])}>"
    return "string"


def fold(types: Iterable[str]) -> str:
    out = "null"
    for t in sorted(set(types)):
        out = promote(out, t)
    return out


# -- metadata records --------------------------------------------------------


def _plain(v):
    """A JSON value with integral floats as integers and keys in order."""
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(v[k]) for k in sorted(v)}
    return v


def json_kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def readable(text: str | None) -> dict | None:
    """The object of a record; null, cut off or other JSON is None."""
    if not text:
        return None
    try:
        v = json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def schema_fields(record: dict) -> dict[str, tuple[str, str]]:
    """Field -> (kind, content) of a record; null fields are absent.

    A feature's kind is its dtype and shape, its content also names and
    description; a top-level field's kind is its JSON type, its content the
    value.  The shapes [] and [1] are the same.
    """
    out: dict[str, tuple[str, str]] = {}
    for name, v in record.items():
        if v is None or name == "features":
            continue
        out[name] = (json_kind(v), json.dumps(_plain(v)))
    features = record.get("features")
    for name, v in (features.items() if isinstance(features, dict) else ()):
        if v is None:
            continue
        spec = v if isinstance(v, dict) else {"dtype": v}
        shape = _plain(spec.get("shape"))
        shape = [1] if shape == [] else shape
        kind = json.dumps([spec.get("dtype"), shape])
        out[f"features.{name}"] = (kind, json.dumps([spec.get("dtype"), shape, _plain(spec.get("names")), spec.get("description")]))
    return out


def version_of(content: str) -> str:
    v = json.loads(content)
    s = str(v).strip().lower()
    return VERSIONS.get(s, s)


def differences(old: dict[str, tuple[str, str]], new: dict[str, tuple[str, str]], value_fields: Sequence[str] = VALUE_FIELDS) -> list[tuple[str, str, str]]:
    """(field, change_kind, new_field) in the order of the fields' names.

    A field that goes and one that comes with the same content are a rename;
    where several of the same content go or come, they are paired by name.
    """
    gone = sorted(k for k in old if k not in new)
    come = sorted(k for k in new if k not in old)
    out, taken = [], set()
    by_content: dict[tuple[bool, str, str], list[str]] = {}
    for k in come:
        by_content.setdefault((k.startswith("features."), *_same(new[k])), []).append(k)
    for k in gone:
        match = by_content.get((k.startswith("features."), *_same(old[k])))
        if match:
            to = match.pop(0)
            taken.add(to)
            out.append((k, "renamed", to))
        else:
            out.append((k, "removed", ""))
    out += [(k, "added", "") for k in come if k not in taken]
    for k in sorted(old.keys() & new.keys()):
        if old[k][0] != new[k][0]:
            out.append((k, "retyped", ""))
        if k in value_fields:
            a, b = old[k][1], new[k][1]
            if k == "codebase_version":
                a, b = version_of(a), version_of(b)
            if a != b:
                out.append((k, "changed", ""))
    return sorted(out)


def _same(field: tuple[str, str]) -> tuple[str, str]:
    return field[0], field[1]


def snapshot_schemas(snapshots: DataFrame, stream: str, revision: str, record: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns stream, revision, keep..., fields (JSON) of readable snapshots.

    A revision that is stored several times counts once, with the smallest
    record that is readable.
    """
    keep = list(keep)
    rows = snapshots.where(F.col(stream).isNotNull() & F.col(revision).isNotNull() & F.col(record).isNotNull()).select(
        F.col(stream).alias("stream"), F.col(revision).alias("revision"), *keep, F.col(record).alias("__record")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", fields string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in b.column(b.num_columns - 1).to_pylist():
                v = readable(t)
                made.append(None if v is None else json.dumps(schema_fields(v)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], names=[*b.schema.names[:-1], "fields"])

    parsed = rows.mapInArrow(parse, schema).where(F.col("fields").isNotNull())
    return parsed.groupBy("stream", "revision").agg(F.min("fields").alias("fields"), *[F.min(k).alias(k) for k in keep])


def with_previous(rows: DataFrame, stream: str, order: str, value: str, *, block: int = 256) -> DataFrame:
    """Adds ``previous``, the value of the next lower ``order`` in the stream.

    A stream may be any part of all rows: it is cut in blocks of ``block``
    orders, each a window of its own, and the first of a block looks at the
    last of the block before it that has any.  ``order`` is an integer that is
    unique in its stream.
    """
    cut = rows.withColumn("__b", F.floor(F.col(order) / F.lit(block)))
    w = Window.partitionBy(stream, "__b").orderBy(order)
    inner = cut.withColumn("__p", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    last = cut.groupBy(stream, "__b").agg(F.max_by(value, order).alias("__last"))
    across = last.select(stream, "__b", F.lag("__last").over(Window.partitionBy(stream).orderBy("__b")).alias("__before"))
    joined = inner.join(across, [stream, "__b"])
    return joined.withColumn("previous", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__p"))).drop("__b", "__p", "__first", "__before")


def snapshot_changes(snapshots: DataFrame, stream: str, revision: str, record: str) -> DataFrame:
    """Columns stream, revision, field, change_kind, new_field of all changes."""
    rows = store(snapshot_schemas(snapshots, stream, revision, record))  # parsed once
    pairs = with_previous(rows, "stream", "revision", "fields").where(
        F.col("previous").isNotNull() & (F.col("previous") != F.col("fields"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = f"stream {kinds['stream']}, revision {kinds['revision']}, field string, change_kind string, new_field string"

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, (old, new) in enumerate(zip(b.column("previous").to_pylist(), b.column("fields").to_pylist())):
                for change in differences(json.loads(old), json.loads(new)):
                    at.append(i)
                    found.append(change)
            idx = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("stream").take(idx), b.column("revision").take(idx), *[pa.array([c[k] for c in found], pa.string()) for k in range(3)]],
                names=["stream", "revision", "field", "change_kind", "new_field"],
            )

    return pairs.select("stream", "revision", "fields", "previous").mapInArrow(diff, schema)


def unified_records(snapshots: DataFrame, stream: str, revision: str, record: str) -> DataFrame:
    """One table with the same columns for all readable snapshots.

    A column for each top-level field that occurs, of the type that holds all
    its values: int, bigint, decimal(38,0), double, boolean or, for mixed and
    nested values, string (JSON for nested ones); ``features`` is a map from the
    feature to its kind.  The fields and their types are folded in parallel;
    only the distinct pairs of field and type, as many as the schema is wide,
    reach the driver.
    """
    rows = store(snapshot_schemas(snapshots, stream, revision, record))
    m = F.from_json("fields", "map<string,array<string>>")
    parsed = rows.select(F.col("stream").alias(stream), F.col("revision").alias(revision), m.alias("m"))
    entry = parsed.select(F.explode("m").alias("field", "kc")).where(~F.startswith("field", F.lit("features.")))
    text = F.col("kc")[1]
    number = (
        F.when(text.rlike(r"^-?\d{1,9}$"), "int").when(text.rlike(r"^-?\d{1,18}$"), "bigint").when(text.rlike(r"^-?\d{1,38}$"), "decimal(38,0)")
        .when(text.try_cast("double").isNull() | text.rlike(r"^-?\d+$"), "string").otherwise("double")
    )
    seen = entry.select("field", F.when(F.col("kc")[0] == "number", number).when(F.col("kc")[0] == "boolean", "boolean").otherwise("string").alias("t")).distinct().collect()
    types: dict[str, list[str]] = {}
    for r in seen:
        types.setdefault(r["field"], []).append(r["t"])
    cols = []
    for name in sorted(types):
        raw = F.col("m")[F.lit(name)]
        text = F.when(raw[0] == "string", F.from_json(F.concat(F.lit('{"v":'), raw[1], F.lit("}")), "v string")["v"]).otherwise(raw[1])
        kind = fold(types[name])
        cols.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    kinds = F.map_filter("m", lambda k, v: F.startswith(k, F.lit("features.")))
    features = F.transform_values(F.transform_keys(kinds, lambda k, v: F.substring(k, 10, 1 << 20)), lambda k, v: v[0])
    return parsed.select(stream, revision, *cols, features.alias("features"))


# -- parquet files -------------------------------------------------------------


def file_schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Columns path, ordinal, field, type, read from the footers in parallel.

    Types are Spark's; a field that Spark has no type for is a string.
    """
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "ordinal bigint, path string").repartition(max(1, min(len(paths), 1000)))
    return footer_fields(listed)


def footer_fields(listed: DataFrame) -> DataFrame:
    """Columns path, ordinal, field, type of the files of a table (ordinal, path)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        out: list[list] = [[], [], [], []]
        for b in batches:
            for o, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in pq.read_schema(p.removeprefix("file://")):
                    try:
                        t = "null" if pa.types.is_null(f.type) else from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString()
                    except Exception:  # noqa: BLE001 - no counterpart
                        t = "string"
                    for c, v in zip(out, (p, o, f.name, t)):
                        c.append(v)
        yield pa.RecordBatch.from_pydict({"path": pa.array(out[0], pa.string()), "ordinal": pa.array(out[1], pa.int64()), "field": pa.array(out[2], pa.string()), "type": pa.array(out[3], pa.string())})

    return listed.mapInArrow(read, "path string, ordinal bigint, field string, type string")


def _moves(old: dict[str, str], new: dict[str, str], renames: dict[str, str]) -> list[tuple[str, str, str]]:
    """(field, change, detail) between the schemas of two files."""
    out = []
    come = [f for f in new if f not in old]
    for f in sorted(f for f in old if f not in new):
        if renames.get(f) in come:
            out.append((f, "renamed", renames[f]))
            come.remove(renames[f])
        else:
            out.append((f, "removed", old[f]))
    out += [(f, "added", new[f]) for f in sorted(come)]
    return out + [(f, "retyped", f"{old[f]} to {new[f]}") for f in sorted(old.keys() & new.keys()) if old[f] != new[f]]


def read_drifting(spark: SparkSession, paths: Sequence[str], renames: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All files as one table of the folded schema, and the log of changes.

    ``renames`` maps a field's old name to the new one.  Headers are read and
    compared in parallel; the driver gets the distinct schemas, which it folds,
    and the number of the schema of each file it was given.  Files of one schema
    are read together, so there are as many scans as there are schemas.  The log
    (ordinal, path, field, change, detail) has a row for each difference from
    the file before in the order of ``paths``.
    """
    renames = renames or {}
    pair = F.array_sort(F.collect_list(F.struct("field", "type")))
    files = store(file_schemas(spark, paths).groupBy("path", "ordinal").agg(F.to_json(F.map_from_entries(pair)).alias("schema")))
    pairs = with_previous(files.withColumn("__all", F.lit(0)), "__all", "ordinal", "schema")
    changed = pairs.where(F.col("previous") != F.col("schema")).select("ordinal", "path", "previous", "schema")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(o, p, *c) for o, p, old, new in zip(*(b.column(i).to_pylist() for i in range(4))) for c in _moves(json.loads(old), json.loads(new), renames)]
            kinds = {"ordinal": pa.int64(), "path": pa.string(), "field": pa.string(), "change": pa.string(), "detail": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    log = changed.mapInArrow(compare, "ordinal bigint, path string, field string, change string, detail string")
    distinct = files.groupBy("schema").agg(F.min("ordinal").alias("first")).orderBy("first").collect()  # as many as there are schemas
    number = {r["schema"]: i for i, r in enumerate(distinct)}
    which = F.create_map(*[F.lit(x) for kv in number.items() for x in kv]) if number else F.create_map()
    of_file = [(r[0], r[1]) for r in files.select("ordinal", which[F.col("schema")].alias("k")).collect()] if number else []  # two numbers for each given path
    schemas = [json.loads(r["schema"]) for r in distinct]
    union: dict[str, str] = {}
    for schema in schemas:
        for f, t in schema.items():
            name = renames.get(f, f)
            union[name] = promote(union.get(name, "null"), t)
    table = None
    for k, schema in enumerate(schemas):
        have = {renames.get(f, f): f for f in schema}
        df = spark.read.parquet(*[paths[o] for o, s in sorted(of_file) if s == k])
        cols = []
        for name, t in union.items():
            kind = "string" if t == "null" else t
            cols.append((F.col(f"`{have[name]}`").cast(kind) if name in have else F.lit(None).cast(kind)).alias(name))
        part = df.select(*cols)
        table = part if table is None else table.unionByName(part)
    return table, log
