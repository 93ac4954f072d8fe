"""Token budget per source and language (problem 5).

For a longest-match subword vocabulary the count is exact and linear: a trie whose nodes carry
a failure link and the number of tokens that are emitted when the link is taken, both worked out
once per vocabulary. Letters outside the vocabulary cost one token per UTF-8 byte, as under
byte fallback. For a merge-based tokenizer the same count is an estimate; ``calibration``
reports how far it is off over all texts.

Defined cases: null and blank texts have 0 tokens and are not usable; a text that arrived
before (the first by arrival, then by id) is counted in the totals but not as usable; null or blank
slices are ``unknown``; language tags are cleaned to their base code, ``und`` and null to
``unknown``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.spread import spread_out
from quillspark.session import materialize

MARK = "▁"  # the word-start mark of piece vocabularies

# fixed values: three-letter and unofficial codes
CODES = {
    "eng": "en", "por": "pt", "spa": "es", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "rus": "ru",
    "ara": "ar", "jpn": "ja", "jp": "ja", "zho": "zh", "chi": "zh", "cn": "zh", "ita": "it", "kor": "ko", "kr": "ko",
}
_NONE = ("", "und", "unk", "unknown", "null", "none", "xx", "mul", "zxx", "n/a")


def clean_language(tag: Column) -> Column:
    """The base code of a language tag, lower case; ``unknown`` if there is none."""
    base = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]*)", 1)
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = F.coalesce(table[base], base)
    return F.when(code.isNull() | code.isin(*_NONE), F.lit("unknown")).otherwise(code)


class LongestMatch:
    """Counts longest-match tokens by a trie with failure links and precomputed emissions."""

    def __init__(self, pieces: list[str]):
        self.go: dict[int, int] = {}
        chars: list[int] = [0]
        parent: list[int] = [0]
        depth: list[int] = [0]
        ends: list[int] = [0]  # tokens that the node's string costs as a whole, 0 if it is no piece
        go = self.go
        self.local = not any(MARK in p.lstrip(MARK) for p in pieces)
        letters = {c for p in pieces for c in p}
        whole = set(pieces)
        for p in sorted(whole | letters):
            at = 0
            for c in p:
                key = (at << 21) | ord(c)
                nxt = go.get(key)
                if nxt is None:
                    nxt = go[key] = len(chars)
                    chars.append(ord(c))
                    parent.append(at)
                    depth.append(depth[at] + 1)
                    ends.append(0)
                at = nxt
            if at:
                ends[at] = 1 if p in whole else len(p.encode())
        self.fail = [0] * len(chars)
        self.emit = [0] * len(chars)
        for v in sorted(range(1, len(chars)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.emit[v] = 0, ends[v]
                continue
            u, c = parent[v], chars[v]
            # take links from the parent until the letter can follow; every letter is a piece, so the root always can
            z, sent = self.fail[u], self.emit[u]
            while (z << 21) | c not in go:
                sent += self.emit[z]
                z = self.fail[z]
            self.fail[v], self.emit[v] = go[(z << 21) | c], sent
        self.memo: dict[str, int] = {}

    def run(self, text: str) -> int:
        go, fail, emit = self.go, self.fail, self.emit
        n = at = 0
        for ch in text:
            c = ord(ch)
            nxt = go.get((at << 21) | c)
            while nxt is None:
                if at == 0:
                    break
                n += emit[at]
                at = fail[at]
                nxt = go.get((at << 21) | c)
            if nxt is None:
                n += len(ch.encode("utf-8", "replace"))
            else:
                at = nxt
        while at:
            n += emit[at]
            at = fail[at]
        return n

    def count(self, text: str | None) -> int:
        if not text or not text.strip():
            return 0
        if not self.local:
            return self.run(MARK + text.replace(" ", MARK))
        n, memo = 0, self.memo
        # no piece crosses from a letter to a word mark, so words between single spaces are independent
        for k, w in enumerate(text.split(" ")):
            if not w:
                return self.run(MARK + text.replace(" ", MARK))
            c = memo.get(w)
            if c is None:
                c = self.run(MARK + w)
                if len(memo) < 400_000 and len(w) < 40:
                    memo[w] = c
            n += c
        return n


def piece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    return _pieces(sentencepiece.SentencePieceProcessor(model_file=path))


def _pieces(sp) -> list[str]:
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


_MATCHERS: dict[int, LongestMatch] = {}


def longest_match_counter(spark: SparkSession, pieces: list[str]):
    """A column function text -> number of longest-match tokens. The vocabulary, of fixed size, is broadcast."""
    held = spark.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces[:50])) ^ len(pieces)

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        m = _MATCHERS.get(key)
        if m is None:
            m = _MATCHERS[key] = LongestMatch(held.value)
        return text.map(m.count)

    return count


def token_counts(df: DataFrame, counter, id_col: str, text_col: str, order_col: str, slices: dict[str, Column]) -> DataFrame:
    """One row per record: id, slices, digest of the text, arrival order and tokens."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(order_col).alias("arrived"), F.col(text_col).alias("t"), *[c.alias(k) for k, c in slices.items()])
    src = spread_out(src)
    return src.select("id", "arrived", *slices, F.sha2(F.trim("t"), 256).alias("digest"), counter(F.col("t")).alias("tokens"))


def arrivals(counts: DataFrame) -> DataFrame:
    """Every record with ``usable``: it has tokens and its text did not arrive before. The first arrivals are joined back by id."""
    counts = materialize(counts, "tokens")
    first = counts.where("tokens > 0").groupBy("digest").agg(F.min_by("id", F.struct(_arrival(), "id")).alias("id")).select("id", "digest", F.lit(True).alias("usable"))
    return counts.join(first, ["id", "digest"], "left").withColumn("usable", F.coalesce("usable", F.lit(False))).drop("digest", "arrived")


def _arrival() -> Column:
    return F.coalesce(F.col("arrived").cast("timestamp"), F.lit("9999-01-01").cast("timestamp"))


def budget(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Totals per slice; the usable part has every distinct text once, in the slice where it arrived first."""
    counts = materialize(counts, "tokens")
    total = counts.groupBy(*slices).agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens").alias("tokens_total"))
    first = (
        counts.where("tokens > 0")
        .groupBy("digest")
        .agg(F.min_by(F.struct(*slices, "tokens"), F.struct(_arrival(), "id")).alias("x"))
        .select("x.*")
    )
    usable = first.groupBy(*slices).agg(F.count(F.lit(1)).alias("n_usable"), F.sum("tokens").alias("tokens_usable"))
    return total.join(usable, slices, "left").select(
        *slices, "n_records", F.coalesce("n_usable", F.lit(0)).alias("n_usable"), "tokens_total", F.coalesce("tokens_usable", F.lit(0)).alias("tokens_usable")
    )


def named(col: Column) -> Column:
    return F.when(F.trim(col) != "", F.trim(col)).otherwise(F.lit("unknown"))


_MODELS: dict[str, tuple] = {}


def calibration(df: DataFrame, text_col: str, by: Column, model_path: str) -> DataFrame:
    """(slice, n, estimated, exact, ratio): longest-match counts against the model's own encoding, over every text that is not blank.

    Both counts are made in one pass on the executors; the model file, of fixed size, is broadcast.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    held = df.sparkSession.sparkContext.broadcast(proto)
    key = hashlib.sha256(proto).hexdigest()

    @F.pandas_udf("e long, x long")
    def both(text: pd.Series) -> pd.DataFrame:
        if key not in _MODELS:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=held.value)
            _MODELS[key] = sp, LongestMatch(_pieces(sp))
        sp, m = _MODELS[key]
        rows = [(m.count(t), len(sp.encode(t))) if t and t.strip() else (0, 0) for t in text]
        return pd.DataFrame(rows, columns=["e", "x"], dtype="int64")

    src = spread_out(df.select(by.alias("slice"), F.col(text_col).alias("t")).where(F.trim("t") != ""))
    x = src.select("slice", both("t").alias("c")).select("slice", "c.*")  # a condition on the counts here would be pushed below the exchange and make them twice
    ratio = F.round(F.try_divide(F.sum("e"), F.sum("x")), 4)
    return x.groupBy("slice").agg(F.count_if(F.col("e") > 0).alias("n"), F.sum("e").alias("estimated"), F.sum("x").alias("exact"), ratio.alias("ratio")).where("n > 0")
