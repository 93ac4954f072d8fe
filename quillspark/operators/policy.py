"""Which parts of a conversation are compacted: recency, budget, size, failures, part types, memo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import lines
from quillspark.operators.spread import salted_join


@dataclass(frozen=True)
class Policy:
    mode: str = "auto"  # off, auto or max
    min_chars: int = 2000
    keep_recent: int = 6
    budget_ratio: float = 0.0
    max_chars: int = 100_000
    compact_system: bool = False


def should_consider(text: Column, p: Policy) -> Column:
    """Size and failure gate; mode ``max`` does not lift it."""
    return F.lit(p.mode != "off") & (F.length(text) >= p.min_chars) & ~lines.is_failure(text)


def budget_open(total: Column, limit: Column, p: Policy) -> Column:
    if p.mode == "max" or p.budget_ratio <= 0:
        return F.lit(True)
    return F.coalesce(limit <= 0, F.lit(True)) | F.coalesce(total > limit * p.budget_ratio, F.lit(True))


def conversation_budget(turns: DataFrame, conv: str, text: str, limit: int | None, p: Policy) -> DataFrame:
    """(conv, total_tokens, is_open): a quarter of the letters of all turns joined by blanks."""
    chars = F.sum(F.length(F.coalesce(F.col(text), F.lit("")))) + F.count(F.lit(1)) - 1
    t = turns.groupBy(conv).agg(F.ceil(chars / 4).cast("long").alias("total_tokens"))
    return t.withColumn("is_open", budget_open(F.col("total_tokens"), F.lit(limit).cast("long"), p))


def with_recency(turns: DataFrame, conv: str, turn: str, p: Policy, tie: str = "received_at") -> DataFrame:
    """Adds ``from_end`` and ``is_recent``: the last turns are kept as they are. A conversation is one window."""
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc(), F.col(tie).desc())
    x = turns.withColumn("from_end", F.row_number().over(w))
    return x.withColumn("is_recent", F.col("from_end") <= p.keep_recent)


def mark_recent(turns: DataFrame, conv: str, turn: str, p: Policy, tie: str = "received_at", salts: int = 16) -> DataFrame:
    """Adds ``is_recent`` without ranking whole conversations.

    The last turns of each salted part of a conversation, then of those parts together, give the
    place from which turns are recent; a conversation of any size is spread over tasks.
    """
    place = F.struct(F.coalesce(F.col(turn), F.lit(-1)).alias("a"), F.col(tie).alias("b"))
    x = turns.withColumn("__place", place)
    part = Window.partitionBy(conv, "__salt").orderBy(F.desc("__place"))
    last = x.select(conv, "__place").withColumn("__salt", F.pmod(F.xxhash64("__place"), F.lit(salts)))
    last = last.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= p.keep_recent)
    both = last.withColumn("__r", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("__place")))).where(F.col("__r") <= p.keep_recent)
    cut = both.groupBy(conv).agg(F.min("__place").alias("__cut"))
    out = salted_join(x, cut, conv, F.col("__place"), "left", salts)
    return out.withColumn("is_recent", F.coalesce(F.col("__place") >= F.col("__cut"), F.lit(False))).drop("__place", "__cut")


def eligible_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, limit: int | None, p: Policy) -> DataFrame:
    """Every turn with ``eligible``: old enough, its conversation over budget, large and no failure; system turns only on request."""
    x = salted_join(mark_recent(turns, conv, turn, p), conversation_budget(turns, conv, text, limit, p), conv, F.col(turn))
    is_system = F.coalesce(F.lower(F.trim(role)) == "system", F.lit(False))
    ok = ~F.col("is_recent") & F.col("is_open") & F.coalesce(should_consider(F.col(text), p), F.lit(False))
    return x.withColumn("eligible", ok & (F.lit(p.compact_system) | ~is_system))


def part_route(kind: Column, result_kind: Column) -> Column:
    """Which part of a message may change: ``text``, ``value`` or ``content`` items, or none."""
    of_result = F.when(result_kind.isin("text", "json"), "value").when(result_kind == "content", "content").otherwise("none")
    return F.when(kind == "text", "text").when(kind == "tool-result", F.coalesce(of_result, F.lit("none"))).otherwise("none")


def once_per_payload(df: DataFrame, text: str, out: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` (adds ``out`` from ``payload``) once per distinct payload and hand the result to all rows that carry it.

    Payloads meet by digest, so the wide text is shuffled once and hot payloads are one row.
    """
    keyed = df.withColumn("_d", F.sha2(F.col(text), 256))
    unique = keyed.where(F.col(text).isNotNull()).groupBy("_d").agg(F.first(text).alias("payload"))
    return keyed.join(work(unique).select("_d", out), "_d", "left").drop("_d")


def keep_if_smaller(before: Column, after: Column) -> Column:
    """The new text only where its token estimate falls."""
    return F.when(lines.estimate_tokens(after) < lines.estimate_tokens(before), after).otherwise(before)
