"""Savings ledger: summaries, groups, days, filters and text reports, all by partial aggregation.

A ledger row has ts (epoch seconds), source, cwd, model, session, in_chars, out_chars, units,
kept, protected and ms; any of them may be null. Characters count as a quarter token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BARS = "▁▂▃▄▅▆▇█"  # fixed values: the levels of a sparkline


def tokens(chars: Column) -> Column:
    return F.floor(chars * 0.25).cast("long")


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def human(value: Column) -> Column:
    """1234567 as 1.2M; below a thousand without decimals."""
    v = value.cast("double")
    out = F.when(F.abs(v) < 1000, v.cast("long").cast("string"))
    for k, unit in enumerate("KMBT", 1):
        out = out.when(F.abs(v) < 1000.0 ** (k + 1), F.concat(F.format_string("%.1f", v / 1000.0**k), F.lit(unit)))
    return out.otherwise(F.concat(F.format_string("%.1f", v / 1e15), F.lit("P")))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Requests, tokens in, out and saved, units, time; over all rows or per key."""
    t = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(_n("in_chars")).alias("i"), F.sum(_n("out_chars")).alias("o"), F.sum(_n("ms").cast("decimal(28,6)")).alias("m"), F.sum(_n("units")).alias("units"), F.sum(_n("kept")).alias("kept_units")
    )
    t = t.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("i", "o", "units", "kept_units")}).withColumn("m", F.coalesce(F.col("m").cast("double"), F.lit(0.0)))
    saved = F.greatest(F.lit(0), F.col("i") - F.col("o"))
    return t.select(
        *keys, "requests", tokens(F.col("i")).alias("input_tokens"), tokens(F.col("o")).alias("output_tokens"), tokens(saved).alias("saved_tokens"), percent(saved, F.col("i")).alias("saved_pct"),
        "units", "kept_units", percent(F.col("kept_units"), F.col("units")).alias("kept_pct"), F.bround("m", 1).alias("total_ms"), F.when(F.col("requests") > 0, F.bround(F.col("m") / F.col("requests"), 1)).otherwise(0.0).alias("avg_ms"),
    )


def named(col: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("unknown"))


def by_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(named(key).alias("name")).agg(F.count(F.lit(1)).alias("requests"), F.sum(_n("in_chars")).alias("in_chars"), F.sum(_n("out_chars")).alias("out_chars"))


def top_groups(df: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The groups with most input, with their savings; ties by name."""
    saved = F.greatest(F.lit(0), F.col("in_chars") - F.col("out_chars"))
    g = by_key(df, key).orderBy(F.desc("in_chars"), "name").limit(most)
    return g.select("name", "requests", tokens(saved).alias("saved_tokens"), human(tokens(saved)).alias("saved_text"), percent(saved, F.col("in_chars")).alias("saved_pct"))


def by_day(df: DataFrame) -> DataFrame:
    day = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd")
    return df.where("ts is not null and not isnan(ts)").groupBy(day.alias("day")).agg(F.sum(F.greatest(F.lit(0), _n("in_chars") - _n("out_chars"))).cast("long").alias("saved_chars"))


def saved_on(df: DataFrame, day: str) -> DataFrame:
    """The day's savings in tokens; only that day's rows are read into the aggregation."""
    start = F.unix_timestamp(F.lit(day), "yyyy-MM-dd")
    hit = df.where((F.col("ts") >= start) & (F.col("ts") < start + 86400))
    return hit.agg(tokens(F.coalesce(F.sum(F.greatest(F.lit(0), _n("in_chars") - _n("out_chars"))), F.lit(0))).alias("saved_tokens"))


def recent_days(df: DataFrame, most: int = 14) -> DataFrame:
    """The last days that have rows, each with its level of a sparkline; one row per day is sorted."""
    d = by_day(df).orderBy(F.desc("day")).limit(most)
    peak = F.max("saved_chars").over(Window.partitionBy(F.lit(1)))
    level = F.when(peak > 0, F.least(F.lit(7), F.floor(F.col("saved_chars") / peak * 7))).otherwise(0).cast("int")
    return d.withColumn("level", level).withColumn("bar", F.substring(F.lit(BARS), F.col("level") + 1, F.lit(1)))


def sparkline(df: DataFrame, most: int = 14) -> DataFrame:
    r = recent_days(df, most)
    bars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "bar"))), lambda x: x["bar"]), "")  # at most ``most`` rows
    return r.agg(F.count(F.lit(1)).alias("days"), bars.alias("line"), F.max("saved_chars").alias("peak_chars"))


def in_project(df: DataFrame, cwd: str) -> DataFrame:
    """Rows of a folder and of the folders above it; rows without a folder belong to none."""
    parts = cwd.rstrip("/").split("/")
    above = ["/".join(parts[:k]) for k in range(2, len(parts) + 1)]
    return df.where(F.col("cwd").isin(*above))


def in_session(df: DataFrame, session: str) -> DataFrame:
    return df.where(F.col("session") == session)


def since_days(df: DataFrame, now: float, days: int) -> DataFrame:
    return df.where(F.col("ts") >= now - days * 86400)


def one_line(df: DataFrame, day: str | None = None, session: str | None = None) -> DataFrame:
    """One status line; that of a session has no totals of other sessions."""
    rows = in_session(df, session) if session else df
    s = summary(rows)
    head = F.concat(human(F.col("saved_tokens")), F.lit(" saved · "), F.col("saved_pct").cast("string"), F.lit("%"))
    if session or day is None:
        return s.select(F.when(F.col("requests") > 0, head).otherwise("no data").alias("line"))
    s = s.join(F.broadcast(saved_on(df, day).withColumnRenamed("saved_tokens", "today")))  # one row each
    return s.select(F.when(F.col("requests") > 0, F.concat(head, F.lit(" · "), F.col("requests").cast("string"), F.lit(" reqs · today "), human(F.col("today")))).otherwise("no data").alias("line"))


def render(df: DataFrame, scope: str = "Global Scope", spark_days: bool = False, breakdown: bool = True) -> str:
    """The report as text. Only aggregates reach the driver: one summary row, two lists of ten, fourteen days."""
    s = summary(df).first()
    h = human(F.col("v"))
    spark = df.sparkSession
    names = ["input_tokens", "output_tokens", "saved_tokens"]
    shown = dict(zip(names, (r[0] for r in spark.createDataFrame([(k, s[n]) for k, n in enumerate(names)], "k int, v long").orderBy("k").select(h).collect())))
    out = [
        f"Savings ({scope})", "=" * 44, f"Requests:        {s['requests']}", f"Input tokens:    {shown['input_tokens']}", f"Output tokens:   {shown['output_tokens']}",
        f"Tokens saved:    {shown['saved_tokens']} ({s['saved_pct']}%)", f"Units kept:      {s['kept_units']}/{s['units']} ({s['kept_pct']}%)", f"Engine time:     {s['total_ms']}ms (avg {s['avg_ms']}ms)",
    ]
    if spark_days:
        line = sparkline(df).first()
        out.append(f"Last {line['days']}d:      {line['line']}")
    for key, title in (("source", "By Source"), ("cwd", "By Project")) if breakdown else ():
        out += ["", title, "-" * 44] + [f"  {r['name'][:28]:<28} {r['requests']:>6}  {r['saved_text']:>7}  {r['saved_pct']:>5}%" for r in top_groups(df, key).collect()]
    return "\n".join(out)
