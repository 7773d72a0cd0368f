"""Feature specifications and their Spark and Arrow types."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

#: Dtypes and the columns that every dataset has.
_TYPES = {
    "float32": (T.FloatType(), pa.float32()),
    "float64": (T.DoubleType(), pa.float64()),
    "int64": (T.LongType(), pa.int64()),
    "int32": (T.IntegerType(), pa.int32()),
    "bool": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "language": (T.StringType(), pa.string()),
}
MEDIA = ("image", "video")
TEXT = ("string", "language")
#: Key of the schema metadata that public dataset readers look for.
SCHEMA_KEY = b"huggingface"


class FeatureError(ValueError):
    """A feature, a frame or a configuration that the data model refuses."""


@dataclass(frozen=True)
class FeatureSpec:
    """dtype and shape of a feature; further JSON keys survive in ``extra``."""

    dtype: str
    shape: tuple[int, ...] = ()
    names: object = None
    info: object = None
    extra: Mapping = field(default_factory=dict)

    @classmethod
    def of(cls, d: Mapping) -> FeatureSpec:
        known = {"dtype", "shape", "names", "info"}
        return cls(d["dtype"], tuple(d.get("shape") or ()), d.get("names"), d.get("info"), {k: v for k, v in d.items() if k not in known})

    def to_dict(self) -> dict:
        d = {**self.extra, "dtype": self.dtype, "shape": list(self.shape), "names": self.names}
        return d | ({"info": self.info} if self.info is not None else {})

    def canonical(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @property
    def scalar(self) -> bool:
        return self.shape in ((), (1,))

    @property
    def media(self) -> bool:
        return self.dtype in MEDIA

    @property
    def numeric(self) -> bool:
        return not self.media and self.dtype not in TEXT


Features = dict[str, FeatureSpec]

DEFAULT_FEATURES: Features = {
    "timestamp": FeatureSpec("float32", (1,)),
    "frame_index": FeatureSpec("int64", (1,)),
    "episode_index": FeatureSpec("int64", (1,)),
    "index": FeatureSpec("int64", (1,)),
    "task_index": FeatureSpec("int64", (1,)),
}


def parse_features(data: Mapping | str) -> Features:
    """Features from their JSON; an empty map is an error."""
    d = json.loads(data) if isinstance(data, str) else data
    if not d:
        raise FeatureError("no features")
    return {k: FeatureSpec.of(v) for k, v in d.items()}


def with_defaults(features: Features) -> Features:
    """The default columns win over a feature of the same name."""
    return {**features, **DEFAULT_FEATURES}


def without_defaults(features: Features) -> Features:
    return {k: v for k, v in features.items() if k not in DEFAULT_FEATURES}


def keys_of(features: Features, *dtypes: str) -> list[str]:
    return sorted(k for k, v in features.items() if v.dtype in dtypes)


def data_columns(features: Features) -> list[str]:
    """Columns of the data files, in their order: all but the videos."""
    return sorted(k for k, v in features.items() if v.dtype != "video")


def check_media(features: Features, use_videos: bool) -> None:
    if not use_videos and keys_of(features, "video"):
        raise FeatureError(f"video features need videos: {keys_of(features, 'video')}")


def check_columns(columns: list[str], features: Features, *, others: tuple[str, ...] = ("task",)) -> None:
    """Every declared column that is not made by us must be there, no other."""
    needed = {k for k, v in features.items() if not v.media and k not in DEFAULT_FEATURES}
    unknown = sorted(c for c in columns if c not in features and c not in others)
    missing = sorted(needed - set(columns))
    if unknown or missing:
        raise FeatureError(f"unknown columns {unknown}, missing columns {missing}")


def parse_stats_mode(text: str) -> str:
    """sampled (also sample and empty), full or none, in any case."""
    mode = {"": "sampled", "sample": "sampled"}.get(text.strip().lower(), text.strip().lower())
    if mode not in ("sampled", "full", "none"):
        raise FeatureError(f"unsupported stats mode {text!r}")
    return mode


def owned_features(features: Features, external_videos: bool) -> Features:
    """Features whose statistics are ours: not the videos', if the caller makes
    those."""
    return {k: v for k, v in features.items() if not (external_videos and v.dtype == "video")}


def spark_type(spec: FeatureSpec) -> T.DataType:
    if spec.dtype == "image":
        return T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
    if spec.dtype not in _TYPES:
        raise FeatureError(f"unsupported dtype {spec.dtype!r}")
    t: T.DataType = _TYPES[spec.dtype][0]
    for _ in () if spec.scalar else spec.shape:
        t = T.ArrayType(t)
    return t


def arrow_type(spec: FeatureSpec) -> pa.DataType:
    """Exact type on disk: fixed-size lists for vectors and tensors."""
    if spec.dtype == "image":
        return pa.struct([("bytes", pa.binary()), ("path", pa.string())])
    if spec.dtype not in _TYPES:
        raise FeatureError(f"unsupported dtype {spec.dtype!r}")
    t = _TYPES[spec.dtype][1]
    for n in () if spec.scalar else reversed(spec.shape):
        t = pa.list_(t, n)
    return t


def struct_type(features: Features) -> T.StructType:
    return T.StructType([T.StructField(k, spark_type(features[k]), True, {"feature": features[k].to_dict()}) for k in data_columns(features)])


def _entry(spec: FeatureSpec) -> dict:
    if spec.dtype == "image":
        return {"_type": "Image"}
    value = {"dtype": "string" if spec.dtype in TEXT else spec.dtype, "_type": "Value"}
    if spec.scalar or spec.dtype in TEXT:
        return value
    if len(spec.shape) == 1:
        return {"feature": value, "length": spec.shape[0], "_type": "Sequence"}
    return {"shape": list(spec.shape), "dtype": spec.dtype, "_type": f"Array{len(spec.shape)}D"}


def arrow_schema(features: Features) -> pa.Schema:
    """Schema of a data file, with the metadata that public readers expect."""
    cols = data_columns(features)
    described = {"info": {"features": {k: _entry(features[k]) for k in cols}}}
    return pa.schema([pa.field(k, arrow_type(features[k])) for k in cols], metadata={SCHEMA_KEY: json.dumps(described).encode()})


def features_equal(a: Features, b: Features) -> bool:
    return a.keys() == b.keys() and all(a[k].canonical() == b[k].canonical() for k in a)


def same_schema(a: T.StructType, b: T.StructType, *, nullable: bool = True) -> bool:
    """Names and types by position, and nullability unless it is left out;
    metadata does not count."""
    plain = lambda t: t if nullable else t.simpleString()  # noqa: E731 - has no nullability
    return [(f.name, plain(f.dataType), f.nullable or not nullable) for f in a] == [(f.name, plain(f.dataType), f.nullable or not nullable) for f in b]
