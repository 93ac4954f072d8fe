"""Arrow-batched column functions over the kernels, and their registration for SQL as ``tc_*``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import code, grammar, pairs, payloads, spans

SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start_off", T.IntegerType()), T.StructField("end_off", T.IntegerType())]))
STRINGS = T.ArrayType(T.StringType())
INTS = T.ArrayType(T.IntegerType())


def _guard(f: Callable, *values):
    return None if any(v is None for v in values) else f(*values)


def over(f: Callable, kind: T.DataType):
    """A column function of one or more columns; null in, null out."""

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        rows = zip(*(c.where(c.notna(), None) if c.dtype == object else c for c in cols))
        return pd.Series([_guard(f, *r) for r in rows], dtype="object")

    return run


def _spans(find: Callable) -> Callable:
    return lambda t: [(t[a:b], a, b) for a, b in find(t)]


def compaction_prelude(text: str) -> str:
    """Base64, JSON and rules in one crossing; the log stage runs before it in the JVM."""
    return spans.compress_rules(payloads.compact_json(payloads.compact_base64(text)))


compress_rules = over(spans.compress_rules, T.StringType())
token_count = over(spans.token_count, T.IntegerType())
protected_spans = over(_spans(spans.anchors), SPANS)
risk_spans = over(_spans(spans.risk_sentences), SPANS)
risk_spans_uncapped = over(_spans(lambda t: spans.risk_sentences(t, 0)), SPANS)
sentence_spans = over(_spans(spans.anchor_sentences), SPANS)
split_clauses = over(_spans(spans.clauses), SPANS)
tokenize = over(lambda t: spans.tokens(t), SPANS)
compact_base64 = over(payloads.compact_base64, T.StringType())
compact_json = over(payloads.compact_json, T.StringType())
fold_blocks = over(payloads.fold_blocks, T.StringType())
unfold_blocks = over(payloads.unfold_blocks, T.StringType())
trim_output = over(payloads.trim_output, T.StringType())
trim_echoed = over(lambda t, c: payloads.trim_output(t, c), T.StringType())
echo_ratio = over(payloads.echo_ratio, T.DoubleType())
html_text = over(payloads.html_text, T.StringType())
json_identity = over(lambda t: (lambda v: None if v is None else payloads.identity(v))(payloads._parse(t)), T.StringType())
routable_json = over(lambda t: payloads.is_routable(payloads._parse(t)), T.BooleanType())
error_item = over(lambda t: payloads.is_error_item(payloads._parse(t)), T.BooleanType())
compact_python = over(code.compact_python, T.StringType())
compact_js = over(code.compact_js, T.StringType())
compact_code = over(lambda s, l: code.compact_code(s, l)[0], T.StringType())
without_comments = over(code.without_comments, T.StringType())
normal = over(pairs.normal, T.StringType())
fingerprint = over(pairs.fingerprint, T.StringType())
simhash = over(pairs.simhash, T.LongType())
word_id = over(pairs.word_id, T.IntegerType())
sentence_labels = over(pairs.sentence_labels, INTS)
token_recall = over(pairs.token_recall, T.DoubleType())
token_subsequence = over(pairs.token_subsequence, T.BooleanType())
rewrite_reasons = over(pairs.rewrite_reasons, STRINGS)
contains_exact = over(pairs.contains_exact, T.BooleanType())
contains_natural = over(pairs.contains_natural, T.BooleanType())
prelude = over(compaction_prelude, T.StringType())


rewrite_body = over(lambda t: payloads.rewrite_body(t, compaction_prelude), T.StringType())


def source_chunks(most: int):
    return over(lambda t: pairs.source_chunks(t, most), STRINGS)


def article_chunks(least: int, most: int):
    return over(lambda t: pairs.article_chunks(t, least, most), STRINGS)


SQL = {
    n: f
    for n, f in globals().items()
    if n
    in (
        "compress_rules", "token_count", "protected_spans", "risk_spans", "sentence_spans", "split_clauses", "tokenize", "compact_base64", "compact_json", "fold_blocks", "unfold_blocks", "trim_output",
        "echo_ratio", "html_text", "json_identity", "routable_json", "error_item", "compact_python", "compact_js", "compact_code", "without_comments", "normal", "fingerprint", "simhash", "word_id",
        "sentence_labels", "token_recall", "token_subsequence", "rewrite_reasons", "contains_exact", "contains_natural", "prelude", "rewrite_body",
    )
}


class Clauses:
    """Table function: one row per clause."""

    def eval(self, text: str):
        for k, (a, b) in enumerate(spans.clauses(text or "")):
            yield k, text[a:b], a, b


class SourceChunks:
    """Table function: pieces of at most ``most`` characters."""

    def eval(self, text: str, most: int):
        yield from enumerate(pairs.source_chunks(text or "", most))


class ArticleChunks:
    """Table function: paragraphs packed into chunks of ``least`` to ``most`` characters."""

    def eval(self, text: str, least: int, most: int):
        yield from enumerate(pairs.article_chunks(text or "", least, most))


TABLES = {"tc_clauses": (Clauses, "pos int, clause string, start_off int, end_off int"), "tc_source_chunks": (SourceChunks, "k int, chunk string"), "tc_article_chunks": (ArticleChunks, "k int, chunk string")}


def register(spark: SparkSession) -> list[str]:
    """Make the functions available in SQL; returns their names."""
    names = []
    for name, f in SQL.items():
        spark.udf.register(f"tc_{name}", f)
        names.append(f"tc_{name}")
    for name, (cls, ddl) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=ddl))
        names.append(name)
    return sorted(names)


__all__ = [*SQL, "register", "grammar"]
