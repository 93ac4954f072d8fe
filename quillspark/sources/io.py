"""Scans and sinks: ledger lines, datasets with resume, text files, HTML, request streams."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import delete_path, path_exists

LEDGER = "ts double, source string, cwd string, model string, session string, `in` bigint, `out` bigint, ratio double, units int, kept int, protected int, ms double"
EXAMPLE = "id string, language string, source string, target string, protected_spans array<string>, teacher_model string, created_at bigint"
REQUEST = "id string, text string, meta struct<mode:string,source:string,cwd:string,model:string,session:string,in_chars:double>"
ENV, FOLDER, FILE = "QUILLSPARK_LEDGER", "quillspark", "ledger.jsonl"


def ledger_path(env: dict[str, str] | None = None) -> str:
    """Where the ledger lies: an explicit setting, else the data folder of the desktop standard, else below home."""
    env = dict(os.environ) if env is None else env
    if env.get(ENV):
        return env[ENV]
    base = env.get("XDG_DATA_HOME") or os.path.join(env.get("HOME") or os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, FOLDER, FILE)


def _tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The sound objects among JSON lines; broken lines and lines that hold no object are left out."""
    row = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    x = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{")).select(row.alias("r"))
    return x.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All sound ledger rows, with in_chars and out_chars; broken lines are left out, a missing file is an empty table."""
    rows = _tolerant(spark, path, LEDGER) if path_exists(spark, path) else spark.createDataFrame([], LEDGER)
    return rows.withColumnsRenamed({"in": "in_chars", "out": "out_chars"})


def append_ledger(rows: DataFrame, path: str) -> bool:
    """Append rows; a failure to write is reported, never raised."""
    try:
        rows.withColumnsRenamed({"in_chars": "in", "out_chars": "out"}).write.mode("append").json(path)
        return True
    except Exception:
        return False


def reset_ledger(spark: SparkSession, path: str, confirmed: bool) -> bool:
    """Remove the ledger; refused without confirmation."""
    return delete_path(spark, path) if confirmed else False


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, line ends as newlines."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str = EXAMPLE) -> DataFrame:
    """Dataset lines; the first broken one fails the read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unwritten(new: DataFrame, spark: SparkSession, path: str, key: str = "id", schema: T.StructType | str = EXAMPLE) -> DataFrame:
    """Rows whose key the dataset does not have yet."""
    return new.join(read_dataset(spark, path, schema).select(key).distinct(), key, "left_anti")


def write_dataset(rows: DataFrame, path: str, count: int | None = None, key: str = "id") -> None:
    """Append rows whose key is new, at most ``count`` of them in order of the key."""
    fresh = unwritten(rows.dropDuplicates([key]), rows.sparkSession, path, key, rows.schema)
    (fresh if count is None else fresh.orderBy(key).limit(count)).write.mode("append").json(path)


def example_rows(pairs: DataFrame, now: Column | None = None) -> DataFrame:
    """Generated pairs in dataset form: the id is the start of the source's digest."""
    source = F.trim("source")
    return pairs.select(
        F.substring(F.sha2(F.lower(F.regexp_replace(source, r"(?U)\s+", " ")), 256), 1, 16).alias("id"), F.lower(F.trim("language")).alias("language"), source.alias("source"), F.trim("target").alias("target"),
        "protected_spans", "teacher_model", (now if now is not None else F.unix_timestamp()).cast("long").alias("created_at"),
    )


def parse_requests(lines: DataFrame, col: str = "value") -> DataFrame:
    """(id, text, meta, error) of request lines; a broken line is a row with an error."""
    x = lines.withColumn("_r", F.from_json(F.col(col), REQUEST + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r._bad").isNotNull() | F.col("_r.text").isNull()
    return x.select("_r.id", "_r.text", "_r.meta", F.when(bad, F.lit("invalid request")).alias("error"))
