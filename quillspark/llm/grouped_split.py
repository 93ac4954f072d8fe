"""Train, validation and test splits that keep related records together (problem 3).

Each record names keys: its article, cases and authors. A key that several records share is named by
the smallest of them; keys of one record alone relate nothing. Two names met in one record are an edge of
the graph, whose components are found by hash-to-min: every node keeps a cluster of
nodes, sends the cluster to its smallest member and that member to the others, until nothing
changes. Clusters are rows (node, member), so no cluster has to fit a task, and records that
share a key by the million add one edge between names, not pairs of records. Components go
to splits by weighted rendezvous hashing, which needs no state and moves few components when
weights change.

Defined cases: a null id gives no article; null text gives no case and no author; a
record without keys is a component of its own; rows of one id fall into one component; an empty
table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.spread import hot_join
from quillspark.session import materialize

# fixed values: the tags of cases
CASE_TAGS = ("HND", "CMP", "LGR", "PRX", "ANN", "CKP")

_HANDLE = r"([^\W\d_]+\.[^\W\d_]+)"
_CASE = re.compile(r"(?<![A-Za-z0-9])(" + "|".join(CASE_TAGS) + r")(?:[^\w\n]|_){0,4}(?:n[or]?[.°º]?\s?)?0*([0-9]+)(?![A-Za-z0-9])", re.I)
_AUTHOR = re.compile(
    r"^\W*(?:author|written by|by|from|sender|sent by|writer|reporter|posted by|autor|autora|de|von|auteur|par|por)\s*:\s*(?:[^\n<]{0,60}<)?" + _HANDLE + r"(?=@|>|\)|\s|$)"
    r"|@" + _HANDLE + r"\s+(?:wrote|writes|said|escreveu|escribió|schrieb|a écrit)\b"
    r"|^" + _HANDLE + r"(?:@\S+)?\s+(?:wrote|writes|escreveu|escribió|schrieb|a écrit)\s*:"
    r"|(?:^|\s)(?:—|–|--|―)\s*" + _HANDLE + r"\s*$"
    r"|\[" + _HANDLE + r"\]\s*$",
    re.I | re.M,
)
_COPY = re.compile(r"^\W*b?cc\s*:.*$", re.I | re.M)


def _clean(text: str) -> str:
    if text.isascii():
        return text
    dash = unicodedata.normalize("NFKC", text)
    return "".join(c for c in dash if unicodedata.category(c) != "Cf")


def record_keys(text: str | None) -> list[str]:
    """The case and author keys a text names."""
    if not text:
        return []
    text = _COPY.sub("", _clean(text))
    keys = {f"case:{m[1].upper()}{m[2]}" for m in _CASE.finditer(text)}
    for m in _AUTHOR.finditer(text):
        handle = next(g for g in m.groups() if g)
        keys.add("author:" + handle.casefold())
    return sorted(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_keys(text: pd.Series) -> pd.Series:
    return text.map(record_keys)


def article_key(col: Column) -> Column:
    return F.when(F.trim(col) != "", F.concat(F.lit("article:"), F.regexp_replace(F.trim(col), r":\d+$", "")))


def keyed(df: DataFrame, id_col: str, article_col: str, text_col: str) -> DataFrame:
    """(id, keys): every key of every record."""
    src = df.select(F.col(id_col).cast("long").alias("id"), article_key(F.col(article_col)).alias("a"), text_keys(F.col(text_col)).alias("k"))
    keys = F.array_compact(F.array_append(F.coalesce("k", F.array().cast("array<string>")), F.col("a")))
    return src.where("id is not null").select("id", keys.alias("keys"))


def hash_to_min(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): components of an undirected graph, named by their smallest node.

    A cluster of many nodes is divided over tasks when it is joined with its smallest member.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v <> u")
    both = e.union(e.select("u", "v")).union(e.select("v", F.col("v").alias("u"))).union(e.select(F.col("u").alias("v"), "u"))
    state = materialize(both.distinct(), "clusters")
    last = None
    while True:
        low = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = hot_join(state, low.select("v", "m"), "v", F.col("u"), low.select("v", "n"))
        # the cluster to its smallest member, the smallest member to the cluster
        sent = joined.select(F.col("m").alias("v"), "u").union(joined.select(F.col("u").alias("v"), F.col("m").alias("u")))
        state = materialize(sent.distinct(), "clusters")
        # steady when every node but the smallest of its cluster knows only the smallest
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == last:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        last = now


def components(df: DataFrame, id_col: str, article_col: str, text_col: str) -> DataFrame:
    """(id, group_id): each record's component, named by its smallest record."""
    spark = df.sparkSession
    rows = materialize(keyed(df, id_col, article_col, text_col), "keyed")
    pairs = rows.select("id", F.explode("keys").alias("key"))
    firsts = materialize(pairs.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    held = hot_join(pairs, firsts.select("key", "first"), "key", F.col("id"), firsts.select("key", "n"))
    held = materialize(held.groupBy("id").agg(F.collect_set("first").alias("firsts")).withColumn("node", F.array_min("firsts")), "held")
    edges = held.where(F.size("firsts") > 1).select("node", F.explode("firsts").alias("other")).where("node <> other").distinct()
    # names are records, so the smallest name of a component is its smallest record
    comp = materialize(hash_to_min(edges, "node", "other"), "components")
    placed = hot_join(held.select("id", "node"), comp, "node", F.col("id"), held.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "left")
    placed = placed.select("id", F.coalesce("component", "node").alias("group_id"))
    return rows.select("id").join(placed, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def rendezvous(group: Column, weights: dict[str, float], seed: int = 7) -> Column:
    """The split with the largest score -weight / ln(u): a share of groups equal to its weight, without state."""
    scores = []
    for name, w in weights.items():
        u = (F.xxhash64(F.lit(f"{seed}:{name}"), group).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("s"), F.lit(name).alias("split")))
    return F.array_max(F.array(*scores))["split"]


def assign_splits(groups: DataFrame, weights: dict[str, float], seed: int = 7) -> DataFrame:
    """(id, group_id, new_split)."""
    return groups.withColumn("new_split", rendezvous(F.col("group_id"), weights, seed))


def split_report(split: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per split: rows, groups, the largest group and the wanted and actual shares of rows."""
    sizes = split.groupBy("new_split", "group_id").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("new_split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest_group"))
    scale = sum(weights.values())
    wanted = split.sparkSession.createDataFrame([(k, w / scale) for k, w in weights.items()], "new_split string, wanted double")
    total = per.agg(F.sum("n_rows").alias("all_rows"))
    x = wanted.join(per, "new_split", "left").join(F.broadcast(total))  # one row per split, one total
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return x.select("new_split", zero("n_rows").alias("n_rows"), zero("n_groups").alias("n_groups"), zero("largest_group").alias("largest_group"), "wanted", F.round(F.try_divide(zero("n_rows"), "all_rows"), 6).alias("actual"))
