"""Mixing sources to target weights (problem 7).

Every text is used in one source only, its first record. A source with weight w that holds a
tokens and may be repeated m times allows a mix of at most m * a / w tokens; the smallest such
total is the size of the mix, so all shares can be met. Each record of a source has the
same expected number of copies r = w * total / a <= m. Systematic sampling makes whole copies of it:
with the records of a source in order of size, record i covers the interval
[i * r + u, (i + 1) * r + u) for one random offset u per source and is emitted once per
whole number in it, that is floor(r) or ceil(r) times, never more than m. With u uniform, every
record has the same chance of its further copy. The report names the source that limits the mix.

The prefix sums are ranks, counted by slices, so a source that holds a third of all rows is
never sorted in one task. Defined cases: null or blank texts and records of other or null sources are left out; a
source with weight 0 or without texts gets nothing, and is reported; weights are scaled to sum to 1
over the sources that have texts; repeated texts count once; an empty table gives an empty mix.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.spread import spread_rank
from quillspark.session import materialize


def usable(docs: DataFrame, targets: DataFrame, sizer, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, tokens): one record per distinct text among the wanted sources."""
    wanted = targets.where("weight > 0 and max_repeats > 0").select("source").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("t")).where("id is not null and t is not null and trim(t) <> ''")
    rows = rows.join(F.broadcast(wanted), "source")  # the table of targets names a few sources
    digest = rows.select("id", "source", F.sha2("t", 256).alias("d"), "t")
    first = digest.groupBy("d").agg(F.min(F.struct("id", "source")).alias("x")).select("d", "x.id", "x.source")
    texts = digest.join(first, ["d", "id", "source"], "left_semi").dropDuplicates(["id", "d"])
    return materialize(texts.select("id", "source", sizer(F.col("t")).alias("tokens")).where("tokens > 0"), "usable")


def rates(items: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, float, int]]:
    """(source, weight, max_repeats, expected copies, tokens available); one entry per source."""
    have = {r[0]: int(r[1]) for r in items.groupBy("source").agg(F.sum("tokens")).collect()}  # one row per wanted source
    want = {r[0]: (float(r[1]), int(r[2])) for r in targets.where("weight > 0 and max_repeats > 0").select("source", "weight", "max_repeats").collect()}
    live = {s: w for s, (w, _) in want.items() if have.get(s)}
    scale = sum(live.values()) or 1.0
    total = min((want[s][1] * have[s] / (w / scale) for s, w in live.items()), default=0.0)
    return [(s, want[s][0], want[s][1], live[s] / scale * total / have[s] if s in live else 0.0, have.get(s, 0)) for s in sorted(want)]


def mix(items: DataFrame, targets: DataFrame, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """((id, source, tokens, copies), report of wanted and actual shares)."""
    spark = items.sparkSession
    found = rates(items, targets)
    rng = random.Random(seed)
    table = [(s, w, m, r, a, rng.random(), bool(r) and r > m * (1 - 1e-9)) for s, w, m, r, a in found]
    rate = spark.createDataFrame(table, "source string, weight double, max_repeats int, rate double, available long, offset double, limits boolean")
    # in order of size, by sixteenths of an octave, so that chosen sizes mirror those of the source
    ranked = spread_rank(items, "source", ["tokens"], "id", "rank", slices=8, lead=F.floor(F.log2("tokens") * 16))
    x = ranked.join(F.broadcast(rate.select("source", "rate", "max_repeats", "offset")), "source")  # one row per wanted source
    lo = F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    hi = F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset"))
    chosen = x.withColumn("copies", F.least(hi - lo, F.col("max_repeats").cast("long")).cast("int")).where("copies > 0").select("id", "source", "tokens", "copies")
    chosen = materialize(chosen, "mix")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens_used"), F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    all_used = used.agg(F.sum("tokens_used").alias("all_used"))
    report = F.broadcast(rate).join(used, "source", "left").join(F.broadcast(all_used))  # one row per source, one total
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    report = report.select(
        "source", "weight", "max_repeats", "available", "limits", zero("n_texts"), zero("n_copies"), zero("most_copies"), zero("tokens_used"),
        F.round(F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0)), 6).alias("actual_share"),
        F.round(F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0)) - F.col("weight"), 6).alias("share_error"),
    )
    return chosen, report


def violations(chosen: DataFrame, docs: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """Per wanted source: chosen rows that are of another source, rows used more often than allowed, texts used in two rows.

    ``chosen``: id, source, copies. ``docs``: id, source and digest of every text.
    """
    c = chosen.select(F.col(id_col).alias("id"), F.col("source").alias("as_source"), "copies")
    x = c.join(docs.select(F.col(id_col).alias("id"), F.col("source").alias("own"), "digest"), "id").join(F.broadcast(targets.select(F.col("source").alias("as_source"), "max_repeats")), "as_source")
    rows = x.groupBy("as_source").agg(F.count_if(~F.col("own").eqNullSafe(F.col("as_source"))).alias("n_wrong_source"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_too_often"))
    twice = x.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("as_source").alias("as_source")).where("n > 1").groupBy("as_source").agg(F.count(F.lit(1)).alias("n_same_text"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = targets.select(F.col("source").alias("as_source")).distinct().join(rows, "as_source", "left").join(twice, "as_source", "left")
    return out.select(F.col("as_source").alias("source"), zero("n_wrong_source"), zero("n_too_often"), zero("n_same_text"))
