"""Filling fixed-capacity containers with items (problem 6).

Minimum bin slack over lengths: all items of one length are alike, so a packing is a list of
patterns, each a multiset of lengths and the number of containers filled by it. The next
pattern is found by subset sums over the multiset of remaining lengths, held as bits of one
integer: after each length the reachable sums are kept, the sum closest to the capacity is
taken and its counts are read back. The pattern is used as often as the remaining counts allow, which uses up
at least one length, so there are at most as many patterns as lengths, that is at most
the capacity, whatever the number of items. Only the histogram (one row per length) reaches
the driver; items find their container by their rank within their length.

Items above the capacity are cut into full containers and a remainder; nothing else is
cut. Defined cases: null, blank and empty items (no tokens) get no container; ties are broken
by id; a null or non-positive capacity is left out; an empty table gives no containers; repeated rows are items of their own
if their ids differ.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.spread import spread_rank
from quillspark.session import materialize


def best_pattern(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is as close below ``room`` as can be.

    Counts are split into powers of two, so every step is one shift of the set of reachable sums.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) until every item is placed. Each pattern is built round the longest item left."""
    counts = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = best_pattern({n: c for n, c in counts.items() if c > 0}, capacity - longest) if capacity > longest else {}
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((pattern, times))
    return out


def pieces(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, id, piece_no, start_token, tokens): items above the capacity cut, the rest whole.

    ``items``: id, tokens. ``windows``: window_name, capacity_tokens; a table of a few rows.
    """
    w = windows.where("capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    x = items.where("tokens > 0 and id is not null").select("id", "tokens").join(F.broadcast(w))  # a handful of windows
    last = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")
    x = x.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("piece_no") * F.col("capacity")).cast("int")
    return x.select("window_name", "capacity", "id", "piece_no", start.alias("start_token"), F.least(F.col("capacity"), F.col("tokens") - start).cast("int").alias("size"))


def pack(items: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, bin, id, piece_no, start_token, tokens): the container of every piece."""
    spark = items.sparkSession
    cut = materialize(pieces(items, windows), "pieces")
    sizes = cut.groupBy("window_name", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per window and length, at most the capacity each
    layout: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for name, capacity in sorted({(r[0], r[1]) for r in sizes}):
        hist = {r[2]: r[3] for r in sizes if r[0] == name}
        used: dict[int, int] = {}
        segs: dict[int, list[tuple[int, int, int]]] = {}
        first_bin = 0
        for pattern, times in plan(hist, capacity):
            for length, per in pattern.items():
                segs.setdefault(length, []).append((used.get(length, 0), first_bin, per))
                used[length] = used.get(length, 0) + per * times
            first_bin += times
        layout[name] = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*s)) for n, s in segs.items()}
    held = spark.sparkContext.broadcast(layout)  # patterns times lengths, bounded by the capacities
    ranked = spread_rank(
        cut.withColumn("_key", F.concat_ws("\x00", "window_name", F.col("size").cast("string"))).withColumn("_tie", F.xxhash64("id", "piece_no")), "_key", ["id", "piece_no"], "_tie", "rank"
    ).drop("_key", "_tie")

    def place(batches):
        plans = held.value
        for pdf in batches:
            out = np.zeros(len(pdf), dtype=np.int64)
            for (name, n), idx in pdf.groupby(["window_name", "size"], sort=False).indices.items():
                at, first, per = plans[name][n]
                r = pdf["rank"].to_numpy()[idx]
                k = np.searchsorted(at, r, side="right") - 1
                out[idx] = first[k] + (r - at[k]) // per[k]
            pdf["bin"] = out
            yield pdf[["window_name", "bin", "id", "piece_no", "start_token", "size"]]

    return ranked.select("window_name", "id", "piece_no", "start_token", "size", "rank").mapInPandas(place, "window_name string, bin long, id long, piece_no int, start_token int, size int").withColumnRenamed("size", "tokens")


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, tokens, share of space used and the least number of containers that could hold them."""
    w = windows.select("window_name", "capacity_tokens").distinct()
    per = packed.groupBy("window_name", "bin").agg(F.sum("tokens").alias("t")).groupBy("window_name").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    x = per.join(F.broadcast(w), "window_name")
    return x.select("window_name", "capacity_tokens", "n_bins", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("filled"))


def violations(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: items placed, containers over capacity, items cut that would fit, items whose pieces do not follow one another."""
    w = windows.where("capacity_tokens > 0").select("window_name", "capacity_tokens").distinct()
    full = packed.groupBy("window_name", "bin").agg(F.sum("tokens").alias("t")).join(F.broadcast(w), "window_name").groupBy("window_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"))
    items = packed.groupBy("window_name", "id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("start_token").alias("last"), F.max_by("tokens", "start_token").alias("rest")).join(F.broadcast(w), "window_name")
    per = items.groupBy("window_name").agg(
        F.count(F.lit(1)).alias("n_placed"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_needless_cuts"),
        F.count_if((F.col("last") + F.col("rest") != F.col("t")) | (F.col("n") != F.ceil(F.col("t") / F.col("capacity_tokens")))).alias("n_gaps"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return w.join(per, "window_name", "left").join(full, "window_name", "left").select("window_name", zero("n_placed"), zero("n_overfull"), zero("n_needless_cuts"), zero("n_gaps"))
