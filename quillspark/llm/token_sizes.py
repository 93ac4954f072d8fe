"""Sizes of texts in tokens of a public byte-level tokenizer, used for packing and mixing."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENCODERS: dict[tuple[int, str], object] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes, pattern: str):
    import tiktoken

    key = (hash(data), pattern)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def size(enc, text: str | None) -> int:
    """Tokens of ``text``, encoded whole."""
    return len(enc.encode_ordinary(text)) if text and text.strip() else 0


def token_sizer(spark: SparkSession, ranks_path: str, pattern: str):
    """A column function text -> tokens. The rank file, of fixed size, is broadcast."""
    held = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(T.IntegerType())
    def measure(text: pd.Series) -> pd.Series:
        enc = encoder(held.value, pattern)
        return text.map(lambda t: size(enc, t)).astype("int32")

    return measure
