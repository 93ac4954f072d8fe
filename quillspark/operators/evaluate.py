"""Quality gates: retained spans, ratios, recall, entities, thresholds, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import grammar as g
from quillspark.functions import lines, pairs, spans

ROW = "n_spans int, n_retained int, ratio double, extractive boolean, recall double"


def measured(df: DataFrame, source: str, output: str, target: str | None = None, given: str | None = None) -> DataFrame:
    """Adds ``m``: spans, retained spans, token ratio, ordered subsequence, recall of the target."""

    @F.pandas_udf(ROW)
    def run(s: pd.Series, o: pd.Series, t: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(s, o, t, p):
            a, b = a or "", b or ""
            want = pairs.all_anchors(a, None if d is None else list(d))
            n = len(spans.tokens(a))
            out.append((len(want), sum(x in b for x in want), len(spans.tokens(b)) / n if n else 0.0, pairs.token_subsequence(a, b), None if c is None else pairs.token_recall(c, b)))
        return pd.DataFrame(out, columns=["n_spans", "n_retained", "ratio", "extractive", "recall"]).astype({"recall": "float64"})

    return df.withColumn("m", run(F.col(source), F.col(output), F.col(target) if target else F.lit(None).cast("string"), F.col(given) if given else F.lit(None).cast("array<string>")))


def gate(df: DataFrame, by: str | None = None, min_recall: float = 1.0, min_ratio: float | None = None, max_ratio: float | None = None, min_value_recall: float = 0.8) -> DataFrame:
    """One row per group, or in all: totals, median ratio, means and whether the gate is passed."""
    if (min_ratio is None) != (max_ratio is None):
        raise ValueError("both ratio bounds or neither")
    x = df.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("examples"), F.sum("m.n_spans").alias("protected_spans"), F.sum("m.n_retained").alias("retained_protected_spans"), F.percentile("m.ratio", 0.5).alias("median_compression_ratio"),
        F.avg(F.col("m.extractive").cast("int")).alias("extractive_validity"), F.coalesce(F.avg("m.recall"), F.lit(1.0)).alias("valuable_token_recall"),
    )
    x = x.withColumn("protected_span_recall", F.when(F.col("protected_spans") > 0, F.col("retained_protected_spans") / F.col("protected_spans")).otherwise(1.0))
    x = x.withColumn("protected_span_corruptions", F.col("protected_spans") - F.col("retained_protected_spans"))
    ok = (F.col("protected_span_recall") >= min_recall) & (F.col("extractive_validity") == 1.0) & (F.col("valuable_token_recall") >= min_value_recall) & (F.col("protected_span_corruptions") == 0)
    if min_ratio is not None:
        ok = ok & F.col("median_compression_ratio").between(min_ratio, max_ratio)
    return x.withColumn("passed", ok)


def at_rank(values: Column, index: Column) -> Column:
    return F.get(F.array_sort(values), index.cast("int"))


def by_language(df: DataFrame, key: str, reduction: str, ms: str, n_spans: str, kept: str) -> DataFrame:
    """Median, least and 95th percentile (0-based rank round(.95 n) - 1) per group.

    The percentile is exact and found on counts per value: a value's rank is the number of values before it.
    """
    from pyspark.sql.window import Window

    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("examples"), F.percentile(reduction, 0.5).alias("median_reduction"), F.min(reduction).alias("min_reduction"), F.percentile(ms, 0.5).alias("median_ms"), (F.sum(kept) / F.greatest(F.lit(1), F.sum(n_spans))).alias("protected_recall"))
    c = df.where(F.col(ms).isNotNull()).groupBy(key, ms).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(ms).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(key))
    c = c.withColumn("upto", upto).withColumn("rank", F.greatest(F.lit(0), F.bround(total * 0.95).cast("long") - 1))
    p = c.where("upto > rank").groupBy(key).agg(F.min(ms).alias("p95_ms"))
    return base.join(p, key, "left")


def percentile_floor(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """The value at 0-based rank min(n - 1, floor(share n)); the other percentile formula in use."""
    from pyspark.sql.window import Window

    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    x = c.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return x.where(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * share))).agg(F.min(value).alias("p"))


def threshold_sweep(df: DataFrame, score: str, label: str, steps: int = 99) -> DataFrame:
    """Precision, recall and retention at .01 to .99.

    Rows are counted once by the number of thresholds they pass, at most steps + 1 groups; the
    thresholds meet those counts, not the rows.
    """
    cuts = F.array(*[F.lit(k / 100) for k in range(1, steps + 1)])
    passed = F.size(F.filter(cuts, lambda t: t <= F.col(score)))
    c = df.where(F.col(score).isNotNull()).groupBy(passed.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    t = df.sparkSession.range(1, steps + 1).select((F.col("id") / 100).alias("threshold"), F.col("id").cast("int").alias("j"))
    x = t.join(F.broadcast(c)).groupBy("threshold").agg(  # both sides have at most a hundred rows
        F.sum(F.when(F.col("k") >= F.col("j"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("j"), F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    return x.select(
        "threshold", F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(1.0).alias("recall"), F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(1.0).alias("precision"), (F.col("said") / F.col("n")).alias("retention")
    )


def chosen_threshold(sweep: DataFrame, min_recall: float = 0.95) -> DataFrame:
    """Least retention among thresholds with enough recall, else most recall; ties go to the smaller threshold."""
    x = sweep.withColumn("ok", F.col("recall") >= min_recall)
    key = F.struct((~F.col("ok")).cast("int"), F.when(F.col("ok"), F.col("retention")).otherwise(-F.col("recall")), F.col("threshold"))
    return x.orderBy(key).limit(1).drop("ok")


def best_under(sweep: DataFrame, most: float = 0.7) -> DataFrame:
    return sweep.where(F.col("retention") <= most).orderBy(F.desc("recall"), "threshold").limit(1)


def entities(text: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + g.ENTITIES[kind] if kind != "size" else g.ENTITIES[kind]), F.lit(0)))


def entity_preservation(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, entity, original, preserved, lost, ratio): distinct entities of each kind that survive."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("entity"), entities(F.col(before), k).alias("o"), entities(F.col(after), k).alias("c")) for k in g.ENTITIES]))
    x = df.select(key, rows.alias("x")).select(key, "x.*")
    n, kept = F.size("o"), F.size(F.array_intersect("o", "c"))
    return x.select(key, "entity", n.alias("original"), kept.alias("preserved"), (n - kept).alias("lost"), F.bround(kept / F.greatest(n, F.lit(1)), 3).alias("ratio"))


ERROR_LINE = r"(?iU)\b(FATAL|ERROR|CRITICAL|FAILED|Exception)\b"


def critical_facts(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Error lines and their patterns, digits alike, before and after."""
    errors = lambda c: F.filter(lines.universal_lines(F.col(c)), lambda s: s.rlike(ERROR_LINE))
    pattern = lambda a: F.array_distinct(F.transform(a, lambda s: F.regexp_replace(F.trim(s), r"(?U)\d+", "N")))
    x = df.select(key, errors(before).alias("o"), errors(after).alias("c"))
    total, kept = F.size(pattern(F.col("o"))), F.size(F.array_intersect(pattern(F.col("o")), pattern(F.col("c"))))
    return x.select(key, F.size("o").alias("error_lines_original"), F.size("c").alias("error_lines_compressed"), total.alias("patterns_total"), kept.alias("patterns_preserved"), F.bround(kept / F.greatest(total, F.lit(1)), 3).alias("preservation_rate"))


# fixed values: words left out of the similarity
STOP_WORDS = (
    "a an and are as at be been but by can do does for from had has have he her his i if in into is it its no not of on or our "
    "she so such than that the their them then there these they this those to was we were what when which who will with you your"
).split()


def tfidf_cosine(df: DataFrame, key: str, before: str, after: str, most: int = 5000) -> DataFrame:
    """Cosine of smoothed TF-IDF vectors fitted on each pair alone; the terms with most occurrences, ties by name."""
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    x = df.select(key, F.explode(F.array(F.struct(F.lit(0).alias("d"), words(before).alias("w")), F.struct(F.lit(1).alias("d"), words(after).alias("w")))).alias("x")).select(key, "x.d", F.explode("x.w").alias("w"))
    t = x.groupBy(key, "w").agg(F.sum((F.col("d") == 0).cast("double")).alias("a"), F.sum((F.col("d") == 1).cast("double")).alias("b"))
    from pyspark.sql.window import Window

    t = t.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy((F.col("a") + F.col("b")).desc(), "w"))).where(F.col("r") <= most)
    df_ = (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int")
    idf = F.log(F.lit(3.0) / (df_ + 1)) + 1
    v = t.select(key, (F.col("a") * idf).alias("a"), (F.col("b") * idf).alias("b"))
    s = v.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") ** 2)).alias("na"), F.sqrt(F.sum(F.col("b") ** 2)).alias("nb"))
    return s.select(key, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("ab") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


def required_lines(text: Column, kind: Column) -> Column:
    """What must survive of a diff or a log, as an array of lines."""
    rows = lines.universal_lines(text)
    changed = lambda s: (s.startswith("+") | s.startswith("-")) & ~s.startswith("+++") & ~s.startswith("---")
    head = lambda s: s.startswith("diff --git ") | s.startswith("--- ") | s.startswith("+++ ") | s.startswith("@@ ")
    return F.when(kind == "git_diff", F.filter(rows, lambda s: head(s) | changed(s))).when(kind == "logs", F.filter(rows, lambda s: s.rlike(r"(?U)\b(?:WARN|ERROR|FATAL)\b"))).otherwise(F.array().cast("array<string>"))


def domain_recall(df: DataFrame, kind: Column, before: str, after: str) -> Column:
    """Share of required lines that the output contains."""
    need = required_lines(F.col(before), kind)
    return F.size(F.filter(need, lambda s: F.col(after).contains(s))) / F.greatest(F.lit(1), F.size(need))


def stage_metrics(df: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """Per stage (before, after): rows, characters and the share saved."""
    rows = F.explode(F.array(*[F.struct(F.lit(f"{b}->{a}").alias("stage"), F.length(b).alias("i"), F.length(a).alias("o")) for b, a in stages]))
    x = df.select(rows.alias("x")).select("x.*").where("i is not null")
    return x.groupBy("stage").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("i").alias("in_chars"), F.sum("o").alias("out_chars"), F.round(1 - F.sum("o") / F.greatest(F.lit(1), F.sum("i")), 6).alias("saved"))


def rewrite_gate(df: DataFrame, source_tokens: Column, candidate_tokens: Column) -> DataFrame:
    """Structured rewrites: anchors, edges and modes must agree, eight tokens and 15 % must be saved.

    Columns: source, candidate, anchors, required_edges, candidate_edges, required_modes.
    """
    x = df.withColumn("saved_tokens", source_tokens - candidate_tokens).withColumn("reduction", F.col("saved_tokens") / source_tokens)
    bad = (
        F.exists("anchors", lambda a: ~F.col("source").contains(a) | ~F.col("candidate").contains(a))
        | (F.size(F.array_except("required_edges", "candidate_edges")) > 0)
        | (F.size(F.array_except("candidate_edges", "required_edges")) > 0)
        | F.exists("required_modes", lambda m: ~F.lower("candidate").contains(F.lower(m)))
    )
    x = x.withColumn("consistent", ~bad).withColumn("efficient", (F.col("saved_tokens") >= 8) & (F.col("reduction") >= 0.15))
    return x.withColumn("use", F.col("consistent") & F.col("efficient"))
