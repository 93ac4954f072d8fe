"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spread_rank(df: DataFrame, group: str, order: list[str], tie: str, out: str = "rank", slices: int = 64, lead: Column | None = None) -> DataFrame:
    """A 0-based rank within ``group`` that never sorts one group in a single task.

    Every group is cut into slices: by the integer ``lead``, if given, a coarse form of the
    first order column, and within it into ``slices`` hash slices by ``tie``. Rows are ranked within
    their slice, and the slices of a group are laid end to end by a table of counts that has
    at most groups x leads x slices rows. The rank is a permutation that depends only on the
    data; it follows ``lead``, and within a slice ``order``.
    """
    part = F.pmod(F.xxhash64(F.lit(17), F.col(tie)), F.lit(slices)).cast("long")
    s = df.withColumn("_slice", part if lead is None else lead.cast("long") * slices + part)
    inner = Window.partitionBy(group, "_slice").orderBy(*order, tie)
    ranked = s.withColumn("_in", F.row_number().over(inner) - F.lit(1))
    sizes = s.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        ranked.join(starts, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_slice") == F.col("_s")))
        .withColumn(out, F.col("_in") + F.col("_at"))
        .drop("_slice", "_in", "_g", "_s", "_at")
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join a large, skewed ``left`` with a ``right`` that has one row per key.

    Each key of ``left`` is divided over ``salts`` tasks; ``right`` is repeated that often.
    """
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, key: str, spread_by: Column, sizes: DataFrame, how: str = "inner", salts: int = 16, hot: int = 100_000) -> DataFrame:
    """As ``salted_join``, but only keys with more than ``hot`` rows of ``left`` by ``sizes`` (key, n) are divided and repeated.

    Broadcast are those keys, at most one per ``hot`` rows.
    """
    many = F.broadcast(sizes.where(F.col("n") > hot).select(key, F.lit(salts).alias("_salts")))
    lhs = left.join(many, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    rhs = right.join(many, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out for costly per-row work, if their input is too small to be split over all cores.

    Inputs of two splits per core or more, by the optimizer's estimate of their bytes, stay
    where they are: no shuffle. Smaller ones go to the session's shuffle partitions, at least two per core;
    adaptive execution would merge those by bytes, but leaves a fixed number as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if not keys and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 2 * cores * split:
        return df
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores)
    return df.repartition(n, *keys)
