"""Streaming forms: request lines to answers, ledger aggregates with a watermark, seen-state deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import lines

from quillspark.operators.compaction import REPORT, checkpoint_text
from quillspark.sources.io import parse_requests



def answers(requests: DataFrame, col: str = "value") -> DataFrame:
    """Request lines to answer rows: id, text, ratio, units, kept, protected or error. Stateless; batch or stream."""
    r = parse_requests(requests, col)

    @F.pandas_udf(REPORT)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [(t, 0, 0, 0) if t is None or len(t) < 10 else checkpoint_text(t) for t in text]
        return pd.DataFrame(rows, columns=["text", "units", "kept", "protected"])

    x = lines.compact_logs(r, "text", "__logs").withColumn("__o", run("__logs"))
    ratio = F.when(F.length("text") > 0, F.round(F.length("__o.text") / F.length("text"), 4)).otherwise(1.0)
    return x.select("id", F.col("__o.text").alias("text"), ratio.alias("ratio"), "__o.units", "__o.kept", "__o.protected", "error")


def ledger_windows(ledger: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Requests and saved characters per source and window of event time; rows later than ``late`` are dropped."""
    t = ledger.where("ts is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    saved = F.greatest(F.lit(0), F.coalesce("in_chars", F.lit(0)) - F.coalesce("out_chars", F.lit(0)))
    g = t.groupBy(F.window("at", width), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum(saved).alias("saved_chars")).select(F.col("window.start").alias("start"), "source", "requests", "saved_chars")


def session_totals(ledger: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    """Requests and characters per session of activity."""
    t = ledger.where("ts is not null and session is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    g = t.groupBy(F.session_window("at", gap), "session")
    return g.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.coalesce("in_chars", F.lit(0))).alias("in_chars")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "session", "requests", "in_chars")


def distinct_payloads(rows: DataFrame, text: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of every payload within the watermark."""
    return rows.withWatermark(at, late).withColumn("digest", F.sha2(F.trim(F.col(text)), 256)).dropDuplicatesWithinWatermark(["digest"])


STATE = "hashes array<bigint>"
CHOICES = list(combinations(range(5), 2))  # as in near_pairs: hashes within three bits agree in two of five blocks


def _block_keys(h: np.ndarray) -> list[np.ndarray]:
    """One key per choice of blocks for each hash."""
    u, edges = h.view(np.uint64), [64 * k // 5 for k in range(6)]
    masks = [np.uint64(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k]) for k in range(5)]
    return [u & (masks[a] | masks[b]) for a, b in CHOICES]


def _near_any(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is within three bits of a known one; both sides meet under every choice of blocks."""
    near = np.zeros(len(h), dtype=bool)
    for mine, theirs in zip(_block_keys(h), _block_keys(known)):
        by = np.argsort(theirs)
        first = np.searchsorted(theirs[by], mine)
        times = np.searchsorted(theirs[by], mine, side="right") - first
        # candidate by candidate, so that a block shared by many costs time but no room
        for k in range(int(times.max(initial=0))):
            open_ = np.nonzero((times > k) & ~near)[0]
            if not len(open_):
                break
            apart = (h[open_] ^ known[by[first[open_] + k]]).view(np.uint64)
            near[open_] = np.bitwise_count(apart) <= 3
    return near


def _fresh(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = np.array(state.get[0] if state.exists else [], dtype=np.int64)
    rows = pd.concat(list(batches)).sort_values("id", kind="stable")
    rows = rows[~_near_any(rows["h"].to_numpy(dtype=np.int64), known)]
    hashes = rows["h"].to_numpy(dtype=np.int64)
    index: dict[tuple[int, int], list[int]] = {}
    out, new = [], []
    for i, h, *keys in zip(rows["id"].tolist(), hashes.tolist(), *(k.tolist() for k in _block_keys(hashes))):
        if any(((h ^ g) & ((1 << 64) - 1)).bit_count() <= 3 for k in enumerate(keys) for g in index.get(k, ())):
            continue
        out.append(i)
        new.append(h)
        for k in enumerate(keys):
            index.setdefault(k, []).append(h)
    state.update((known.tolist() + new,))
    yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})


def fresh_examples(rows: DataFrame) -> DataFrame:
    """Ids of rows whose SimHash is more than three bits from those of all rows accepted before, in order of micro-batch, then id.

    Hashes are made on all tasks. Whether a row is accepted depends on all rows accepted before, so that is
    settled at one key, by the blocks of ``near_pairs``; its state is eight bytes per accepted row.
    """
    from quillspark.functions.udfs import simhash

    x = rows.where("text is not null").select("id", simhash("text").alias("h"), F.lit(0).alias("all"))
    return x.groupBy("all").applyInPandasWithState(_fresh, "id bigint", STATE, "append", GroupStateTimeout.NoTimeout)
