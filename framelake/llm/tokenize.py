"""Encoding of a corpus with a public byte-level BPE vocabulary.

tiktoken encodes in Arrow batches with a local rank file, which the driver reads
once and broadcasts (a vocabulary is a few MB, whatever the corpus).  Long texts
are divided where the vocabulary's splitting pattern must end a match anyway, so
the ids are those of the undivided text.  Ids are decoded through their raw
bytes, so that a token that holds part of a character is no difficulty.

Null and empty texts have the empty list of ids.  Strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: the splitting pattern of the published 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts of more characters are divided at safe boundaries.
LONG = 50_000
#: Safe boundaries of PATTERN: every match ends before white space that follows
#: another character, and after a letter that is not followed by a letter, or
#: by an apostrophe, a digit or a mark.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-zぁ-ヿ一-鿿])(?=[,.;:!?()、。！（），：；？])")
_MAX_CACHED = 20_000
_state: dict = {}


def safe_pieces(text: str, size: int = LONG) -> list[str]:
    """Pieces of about ``size`` characters that are encoded independently."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def _encoding(ranks: bytes, pattern: str):
    key = (hash(ranks), pattern)
    if key not in _state:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _state[key] = (tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), {})
    return _state[key]


def _ids(enc, text: str) -> np.ndarray:
    parts = [np.asarray(enc.encode_ordinary(p), dtype=np.int32) for p in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode_corpus(
    documents: DataFrame, text: str, *, ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, ids: str = "ids"
) -> DataFrame:
    """The columns of ``documents`` but ``text``, and ``ids`` (array of int).

    A column already named ``ids`` is replaced.  Rows, repeated ones included,
    are kept; an empty table gives no rows.
    """
    with open(ranks_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in documents.columns if c not in (text, ids)]
    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    arrow = to_arrow_schema(plain)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = _encoding(shared.value, pattern)
        for b in batches:
            found = []
            for t in b.column(len(kept)).to_pylist():
                if not t:
                    found.append(np.empty(0, dtype=np.int32))
                    continue
                got = cache.get(t)
                if got is None:
                    got = _ids(enc, t)
                    if len(t) < 8_000:
                        if len(cache) >= _MAX_CACHED:
                            cache.clear()
                        cache[t] = got
                found.append(got)
            ends = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in found], out=ends[1:])
            if ends[-1] >= 2**31:
                raise ValueError("too many ids in a batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            flat = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(arrow.field(i).type) for i in range(len(kept))], lists.cast(arrow.field(len(kept)).type)], schema=arrow)

    # mapInArrow takes no names with dots, so columns go by their place
    rows = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(encode, plain).toDF(*schema.names)


def decode_corpus(encoded: DataFrame, ids: str, *, ranks_path: str = DEFAULT_RANKS, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """The columns of ``encoded`` but ``ids``, and the decoded ``text``.

    Null ids give a null text.  Bytes that are no UTF-8, which only ids that
    were not made by encoding can give, become the replacement character.
    """
    with open(ranks_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in encoded.columns if c not in (text, ids)]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(text, T.StringType())])
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    arrow = to_arrow_schema(plain)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = _encoding(shared.value, pattern)
        for b in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", errors="replace") for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(arrow.field(i).type) for i in range(len(kept))], pa.array(texts, arrow.field(len(kept)).type)], schema=arrow)

    rows = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(decode, plain).toDF(*schema.names)
