"""Duplicates that differ only in how they are written.

A text is brought to a canonical form with built-in expressions: lower case,
no invisible characters, punctuation and white space as one space, decimal
points and signs of numbers kept; a record of named fields (JSON object, or
``key=value`` and ``key: value`` lists) as its sorted canonical fields.
Characters that are canonically equivalent in Unicode are written alike first.
The form is hashed to 128 bits and copies are counted with map-side combining.
A second, independent hash is part of every comparison and divides forms whose
first hashes collide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import lookup_join, materialize, store

_POINT, _SIGN = "\ue000", "\ue001"
#: Characters without width: format characters and variation selectors.
_INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{34F}\x{115F}\x{1160}\x{3164}]"
_SEPARATOR = r"[\p{P}\p{Z}\p{Cc}|=~`^<>]+"
#: Dividers of a list of fields, in the order in which they are tried.
_DIVIDERS = (r"[;|]", r"[\r\n]+", ",")
#: Characters that may have another canonically equivalent writing: marks, and
#: the blocks with characters that decompose without composing again.
_DOUBTFUL = (
    r"[\p{M}\x{374}\x{37E}\x{387}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}"
    r"\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{FB9}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
)
_KEY = r"[\p{L}_][\p{L}\p{N}_.\-]*"
_FIELD = rf"^\s*[\"']?({_KEY})[\"']?\s*[:=]((?s:.*))$"


def canonical_words(c: Column) -> Column:
    """Lower-case words joined by single spaces; '' if nothing is left."""
    t = F.lower(F.upper(F.regexp_replace(c, _INVISIBLE, "")))
    t = F.regexp_replace(t, r"[\x{2212}\x{FF0D}]", "-")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}\-])-(?=\.?\p{Nd})|(?<=[\p{L}\p{N}]-)-(?=\.?\p{Nd})", _SIGN)
    t = F.regexp_replace(t, r"(?<=\p{Nd})\.(?=\p{Nd})|(?<![\p{L}\p{N}.])\.(?=\p{Nd})", _POINT)
    t = F.trim(F.regexp_replace(t, _SEPARATOR, " "))
    return F.translate(t, _POINT + _SIGN, ".-")


def _fields_text(fields: Column) -> Column:
    """Sorted 'key US value' of an array of structs (k, v)."""
    one = F.transform(fields, lambda f: F.concat(canonical_words(f["k"]), F.lit("\x1f"), canonical_words(F.coalesce(f["v"], F.lit("")))))
    return F.array_join(F.array_sort(one), "\x1e")


def _listed(bare: Column, divider: str) -> Column:
    """The fields of a list with this divider; null if it is none.  What stands
    before the first and after the last divider may be missing."""
    parts = F.filter(F.split(bare, divider), lambda p: p.rlike(r"[^\s\p{Z}]"))
    fields = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, _FIELD, 1).alias("k"), F.regexp_extract(p, _FIELD, 2).alias("v")))
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_FIELD)), fields)


def canonical(c: Column) -> Column:
    """The canonical form of a text; null for null and blank texts.

    Sentences begin with 'S', records of named fields with 'R'.  A JSON object
    is a record, and so is a list of at least two ``key=value`` or
    ``key: value`` parts divided by ';', '|', line breaks or commas: the first
    divider for which every part is a field, so that a list may end with a
    divider of another kind and a value may hold one.
    """
    bare = F.regexp_replace(F.regexp_replace(c, _INVISIBLE, ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    as_map = F.when(bare.rlike(r"^\{(?s:.*)\}$"), F.from_json(bare, "map<string,string>"))
    json_fields = F.when(F.size(as_map) > 0, F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    inner = F.regexp_replace(bare, r"^[\s\p{Z};|,]+|[\s\p{Z};|,]+$", "")
    lists = F.when(inner.rlike(r"[=:].*[;|,\r\n].*[=:]|[=:](?s:.*)[\r\n](?s:.*)[=:]"), F.coalesce(*[_listed(inner, d) for d in _DIVIDERS]))
    record = _fields_text(F.coalesce(json_fields, lists))
    words = canonical_words(bare)
    return F.coalesce(F.concat(F.lit("R"), record), F.concat(F.lit("S"), F.nullif(words, F.lit(""))))


def composed(records: DataFrame, text: str) -> DataFrame:
    """The records with canonically equivalent characters written alike (NFC).

    Nearly all texts are so already; only those with a character that might be
    written otherwise pass through Python.
    """
    schema = records.schema
    at = records.columns.index(text)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([unicodedata.normalize("NFC", t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    doubtful = F.coalesce(F.col(text).rlike(_DOUBTFUL), F.lit(False))
    return records.where(~doubtful).unionByName(records.where(doubtful).mapInArrow(normalise, schema))


def _keyed(records: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, text, hash (128 bits) and second, an independent hash.

    The two are used together, so forms that share a hash are no copies of each
    other unless the second one agrees as well.
    """
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    forms = composed(rows, "text").withColumn("form", canonical(F.col("text"))).where(F.col("form").isNotNull())
    return forms.select("key", "text", F.unhex(F.md5("form")).alias("hash"), F.xxhash64("form", F.length("form")).alias("second"))


def duplicate_groups(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct content: first_key, n_copies, hash, and text.

    ``first_key`` is the smallest key and ``text`` is that record's.  Records
    stored twice (same key) count once.  Null and blank texts are in no group.
    Copies are combined on the map side.
    """
    keyed = _keyed(records, key, text).distinct()
    return (
        keyed.groupBy("hash", "second").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n_copies"), F.min_by("text", "key").alias("text"))
        .select("first_key", "n_copies", F.lower(F.hex("hash")).alias("hash"), "text")
    )


def duplicate_members(records: DataFrame, key: str, text: str) -> DataFrame:
    """Columns first_key, key: every record but the first of its group.

    The form is computed once and only its hashes are kept.  Groups are joined
    back with the hot ones broadcast (``lookup_join``), so a group that holds a
    third of all records is not collected in one task.
    """
    keyed = store(_keyed(records, key, text).select("key", "hash", "second"))
    groups = materialize(keyed.groupBy("hash", "second").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n")).where(F.col("first_key") != F.col("last_key")).drop("last_key"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    found = lookup_join(keyed, groups, ["hash", "second"], n_rows=total, weight="n")
    return found.where(F.col("key") != F.col("first_key")).select("first_key", "key").distinct()
