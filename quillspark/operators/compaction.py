"""Checkpoint and compaction of documents, set at a time.

Rows are parted by what they need before any Python runs: diffs and short texts stay in the
JVM, the rest crosses to Python once for payloads, rules, clauses, spans and mask.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import lines, spans
from quillspark.functions.udfs import compaction_prelude

REPORT = T.StructType([T.StructField("text", T.StringType()), T.StructField("units", T.IntegerType()), T.StructField("kept", T.IntegerType()), T.StructField("protected", T.IntegerType())])


def ratio(out: Column, before: Column) -> Column:
    return F.when(F.length(before) > 0, F.round(F.length(out) / F.length(before), 4)).otherwise(F.lit(1.0))


def checkpoint_text(text: str) -> tuple[str, int, int, int]:
    """(text, units, kept, protected) of one text after its log stage."""
    text = compaction_prelude(text)
    parts = spans.clauses(text)
    if not parts:
        return text, 0, 0, 0
    held = spans.Overlaps(spans.anchors(text) + spans.risk_sentences(text, 0))
    flags = [held(a, b) for a, b in parts]
    keep = [spans.checkpoint_keep(text[a:b], f) for (a, b), f in zip(parts, flags)]
    if not any(keep):
        keep = [True] * len(parts)
    out = spans.render(text, parts, keep)
    return (out if len(out) < len(text) else text), len(parts), sum(keep), sum(flags)


def compact_text(text: str, score: Callable[[list[str]], list[float]], threshold: float, always: bool = False) -> tuple[str, int, int, int]:
    text = compaction_prelude(text)
    parts = spans.clauses(text) if always or len(text) >= 200 else []
    if not parts:
        return text, 0, 0, 0
    texts = [text[a:b] for a, b in parts]
    scores = score(texts)
    held = spans.Overlaps(spans.anchors(text) + spans.risk_sentences(text))
    forced = [held(a, b) for a, b in parts]
    keep = spans.keep_table_heads(texts, [s >= threshold or f for s, f in zip(scores, forced)])
    if not any(keep):
        keep[max(range(len(scores)), key=scores.__getitem__)] = True
    out = spans.render(text, parts, keep)
    return (out if len(out) < len(text) else text), len(parts), sum(keep), sum(forced)


def _routed(df: DataFrame, col: str, least: int, work: Callable[[str], tuple[str, int, int, int]]) -> DataFrame:
    """Adds text_out, units, kept, protected and ratio; diffs and texts below ``least`` never reach Python."""
    x = df.withColumn("_diff", F.coalesce(lines.is_diff(F.col(col)), F.lit(False))).withColumn("_len", F.length(col))
    none = [F.lit(0).alias(c) for c in ("units", "kept", "protected")]
    base = [F.col(c) for c in df.columns]
    diffs = lines.compact_git_diff(x.where("_diff"), col, "text_out").select(*base, "text_out", *none)
    short = x.where(~F.col("_diff") & ((F.col("_len") < least) | F.col("_len").isNull())).select(*base, F.col(col).alias("text_out"), *none)

    @F.pandas_udf(REPORT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([work(t) for t in texts], columns=["text", "units", "kept", "protected"])

    long = lines.compact_logs(x.where(~F.col("_diff") & (F.col("_len") >= least)).drop("_diff", "_len"), col, "logs_out").withColumn("r", run("logs_out"))
    long = long.select(*base, F.col("r.text").alias("text_out"), "r.units", "r.kept", "r.protected")
    return diffs.unionByName(short).unionByName(long).withColumn("ratio", ratio(F.col("text_out"), F.col(col)))


def checkpoint(df: DataFrame, col: str) -> DataFrame:
    """Finished work, decisions, next steps, failures, constraints and anchors of each text."""
    return _routed(df, col, 10, checkpoint_text)


def compact(df: DataFrame, col: str, score: Callable[[list[str]], list[float]], threshold: float = 0.28, always: bool = False) -> DataFrame:
    """Each text without the clauses that ``score`` puts below ``threshold``, anchors and risk sentences kept."""
    return _routed(df, col, 10 if always else 200, lambda t: compact_text(t, score, threshold, always))


# ---- native clause operators

CLAUSE = r"(?dU)([^\n]+?(?:[!?;。！？；؟؛]+|[,،](?=\s)|\.(?=\s|\z)|\z))"


def clause_rows(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pos, clause, start_off, end_off): clauses in the JVM, by lines, offsets by running sums.

    Letters of a line are all part of a match, so offsets are sums of the lengths before.
    """
    from pyspark.sql.window import Window

    src = df.where(F.col(col).isNotNull()).select(key, F.posexplode(F.split(F.col(col), "\n", -1)).alias("ln", "line"))
    before = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    row = src.withColumn("base", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")).where("line <> ''")
    row = row.select(key, "ln", "base", F.regexp_extract_all("line", F.lit(CLAUSE), F.lit(1)).alias("m"))
    cut = row.select(key, "ln", "base", F.posexplode("m").alias("k", "raw"), F.col("m"))
    start = F.col("base") + F.aggregate(F.slice("m", F.lit(1), F.col("k")), F.lit(0), lambda a, s: a + F.length(s))
    bare = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    out = cut.select(key, "ln", "k", bare.alias("clause"), (start + lead).alias("start_off")).where("clause <> ''")
    w = Window.partitionBy(key).orderBy("ln", "k")
    return out.select(key, (F.row_number().over(w) - 1).alias("pos"), "clause", "start_off", (F.col("start_off") + F.length("clause")).alias("end_off"))


def status_flags(clause: Column) -> dict[str, Column]:
    """One boolean per kind of status, narration, label and tool noise, as Catalyst expressions."""
    from quillspark.functions import grammar as g

    at = lambda p: clause.rlike(rf"(?idU)(?<!\w){p}(?!\w)")
    bare = F.regexp_replace(clause, r"(?U)^\s+|\s+$", "")
    out = {f"is_{k}": at(p) for k, p in g.STATUS.items()}
    out["is_narration"] = at(g.NARRATION)
    out["is_label"] = bare.rlike(r"(?d)" + g.LABEL)
    out["is_tool_noise"] = bare.rlike(r"^\.{2,}$") | (bare.rlike("(?idU)" + g.PASS_ROW) & ~at(g.STATUS["fail"]))
    return out


def checkpoint_status(df: DataFrame, key: str, col: str) -> DataFrame:
    """Clauses with their status flags and whether status alone keeps them; no Python."""
    c = clause_rows(df, key, col)
    flags = status_flags(F.col("clause"))
    x = c.withColumns(flags)
    status = F.col("is_next") | F.col("is_done") | F.col("is_decision") | F.col("is_fail") | F.col("is_constraint")
    return x.withColumn("keep_status", ~F.col("is_tool_noise") & status)
