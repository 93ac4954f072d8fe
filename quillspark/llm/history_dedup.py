"""Checking new batches against everything accepted before (problem 1).

A text is a sparse count vector over its folded words, held as the set of its (word,
occurrence) coordinates; the distance of two texts is the Manhattan distance of their count
vectors, ``n_a + n_b - 2 * overlap``. Accepted vectors live in a persisted inverted file of
cells:

* a tree of centres, fitted on a bounded sample (``SAMPLE`` vectors, taken by hash), routes each vector to the nearer of
  two centres at every node; its upper levels make the groups, its leaves are divided into cells of about
  ``cell_rows`` vectors;
* the directory holds for each cell the ring of distances to its group's centre, the range of
  vector lengths and the box of coordinates its vectors have, as ``1 << BOX`` bits;
* the full vectors lie in files of ``cells_per_file`` cells.

A query of length n can only match within distance R = 2 * (n // 8) + 1. It is probed by bounds
on the distance to anything a cell can hold: a side of a node is left out if its centre is
farther than the other by more than 2R (a match lies within R of the query and nearer to its own
centre); a cell is left out if its ring or its range of lengths is out of reach, or if more than n // 8
coordinates of the query lie outside its box. Centre distances are taken between folded vectors of
``WIDTH`` slots, which are never farther apart than the vectors. What remains cannot be excluded;
its files, and only these, are read, and full vectors decide. Accepted rows are appended as further cells. When the
history has grown ``REFIT`` times since the centres were fitted, later cells get new centres.

Directory and queries meet in blocks: a task holds at most ``BLOCK`` cells and about ``PART``
queries, and a query is sent only to blocks with a group within its reach.

Two texts say the same if ``overlap * 8 >= 7 * max(words)``, words counted with repeats.

Deliveries that all lie in one table, with ids that rise from batch to batch, need no index:
``deduplicate_in_order`` takes them in one pass. The coordinates of each vector are put in order of
how many rows hold them, rarest first, counted over all rows. Of a vector of n coordinates a match
lacks n // 8 at most, so the k-th coordinate the two share is among the first n // 8 + k of both. The first one is
their signature; one that more than ``LIGHT`` rows are expected to hold is drawn out by the
second, then the third shared coordinate. Vectors that share no signature cannot match; of those that do, full vectors decide.

Defined cases: null, blank or word-less texts are accepted and never matched; ids are taken to be
unique, of a repeated id within a batch one text is compared; ties go to the smallest
accepted (batch, id); an empty batch changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import io
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.folding import fold_words
from quillspark.operators.spread import spread_out
from quillspark.session import Scratch, delete_path, fresh_path, path_exists

NEED_NUM, NEED_DEN = 7, 8
WIDTH = 256
BOX = 13
SAMPLE = 4096
DEPTH, GROUP_DEPTH, LEAF_SAMPLE = 9, 4, 8
REFIT = 16
BLOCK, PART = 16_384, 8_192
FEW = 500_000
SETTLED_AT_ONCE = 1_000_000
LIGHT, DEEP, LONG, KNOWN = 400, 3, 512, 1_000_000
_MASK = (1 << 63) - 1
_STEP = 0x9E3779B97F4A7C15

VECTOR = "id long, n int, sig string, near_a long, near_b long, leaf int, grp int, ring int, vec array<bigint>"

DIRECTORY = "cell long, gen int, grp int, held long, n_lo int, n_hi int, ring_lo int, ring_hi int, box binary"


class _Hashes(dict):
    """The hash of each word, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) & _MASK
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coordinates(texts, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of (word, occurrence) of all texts end to end, how many each has): set overlap is the overlap of the counts.

    Within a text they stand in an order that depends on its counts only.
    """
    words = [fold_words(t) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    base = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes).tolist()
    for a, b in zip([0, *ends], ends):
        base[a:b].sort()
    at = np.arange(len(base))
    first = np.ones(len(base), dtype=bool)
    first[1:] = (base[1:] != base[:-1]) | (owner[1:] != owner[:-1])
    times = at - np.maximum.accumulate(np.where(first, at, 0))
    again = _mixed(base.astype(np.uint64) + times.astype(np.uint64) * np.uint64(_STEP)) & np.uint64(_MASK)
    return np.where(times == 0, base, again.astype(np.int64)), sizes


def vectors(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sig, vec): the count vector of each text as element hashes; texts without words are left out."""

    def run(batches):
        memo = _Hashes()
        for pdf in batches:
            flat, sizes = coordinates(pdf["text"], memo)
            ends = np.cumsum(sizes).tolist()
            vecs = [flat[a:b] for a, b in zip([0, *ends], ends) if a < b]
            some = sizes > 0
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[some], "n": sizes[some].astype(np.int32), "sig": pd.Series([xxhash.xxh128_hexdigest(v) for v in vecs], dtype="object"), "vec": pd.Series(vecs, dtype="object")})

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return src.mapInPandas(run, "id long, n int, sig string, vec array<bigint>")


def _flat(vecs) -> tuple[np.ndarray, np.ndarray]:
    """(all coordinates, the start of each vector among them); no vector is empty."""
    sizes = np.fromiter((len(v) for v in vecs), dtype=np.int64, count=len(vecs))
    return np.concatenate([np.asarray(v, dtype=np.int64) for v in vecs]), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _folded(slots: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Counts per slot of each vector."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slots))))
    return np.bincount(owner * width + slots, minlength=len(starts) * width).reshape(len(starts), width).astype(np.int32)


def sketches(vecs) -> np.ndarray:
    """The folded vectors: coordinates added up in ``WIDTH`` slots, so no two are farther apart than their vectors."""
    flat, starts = _flat(vecs)
    return _folded((flat >> 16) & (WIDTH - 1), starts, WIDTH)


def _nibbles(flat: np.ndarray, starts: np.ndarray, shift: int) -> np.ndarray:
    """Counts in 16 slots, four bits each, cut off at 15: a short form whose distance never exceeds that of the vectors."""
    c = np.minimum(_folded((flat >> shift) & 15, starts, 16), 15).astype(np.uint64)
    return (c << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _parities(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each of 128 slots holds an odd number of coordinates, as two numbers of 64 bits: vectors differ in no fewer coordinates than these in bits."""
    odd = (_folded((flat >> 24) & 127, starts, 128) & 1).astype(np.uint8)
    return np.packbits(odd, axis=1).view(">u8").astype(np.uint64).astype(np.int64)


def _distance(s: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.abs(s - centre).sum(axis=1)


class CentreTree:
    """Centres in pairs: every node sends a vector to the nearer of its two.

    ``left``/``right`` hold node numbers, or -1 - leaf. Nodes ``GROUP_DEPTH`` levels down, and
    leaves above that, are the roots of the groups.
    """

    def __init__(self, centres: np.ndarray, child: np.ndarray, top: np.ndarray):
        self.centres, self.child, self.top = centres, child, top
        self._index()

    def _index(self) -> None:
        self.group: dict[int, int] = {}
        homes = []
        stack = [(0, 0, self.top)] if len(self.child) else [(-1, 0, self.top)]
        while stack:
            ref, depth, centre = stack.pop()
            if ref < 0 or depth == GROUP_DEPTH:
                self.group[ref] = len(homes)
                homes.append(centre)
            else:
                stack += [(int(self.child[ref, k]), depth + 1, self.centres[ref, k]) for k in (0, 1)]
        self.homes = np.array(homes, dtype=np.int32)

    @classmethod
    def fit(cls, s: np.ndarray) -> CentreTree:
        rng = np.random.default_rng(5)
        centres: list = []
        child: list = []
        leaves = 0
        todo = [(np.arange(len(s)), 0, None, 0)]
        while todo:
            idx, depth, parent, side = todo.pop()
            cut = cls._cut(s[idx], rng) if depth < DEPTH and len(idx) > LEAF_SAMPLE else None
            if cut is None:
                ref = -1 - leaves
                leaves += 1
            else:
                ref = len(child)
                p, q, near = cut
                centres.append((p, q))
                child.append([0, 0])
                todo += [(idx[near], depth + 1, ref, 0), (idx[~near], depth + 1, ref, 1)]
            if parent is not None:
                child[parent][side] = ref
        return cls(np.array(centres, dtype=np.int32).reshape(-1, 2, WIDTH), np.array(child, dtype=np.int32).reshape(-1, 2), np.median(s, axis=0).astype(np.int32))

    @staticmethod
    def _cut(x: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        p = x[_distance(x, x[rng.integers(len(x))]).argmax()]
        q = x[_distance(x, p).argmax()]
        for _ in range(4):
            near = _distance(x, p) <= _distance(x, q)
            if near.all() or not near.any():
                return None
            p, q = np.median(x[near], axis=0).astype(np.int32), np.median(x[~near], axis=0).astype(np.int32)
        near = _distance(x, p) <= _distance(x, q)
        return None if near.all() or not near.any() else (p, q, near)

    def place(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, group, distance to the group's centre) of each folded vector."""
        leaf, grp = np.zeros(len(s), dtype=np.int32), np.zeros(len(s), dtype=np.int32)
        stack = [(0 if len(self.child) else -1, np.arange(len(s)))]
        while stack:
            ref, idx = stack.pop()
            if not len(idx):
                continue
            if ref in self.group:
                grp[idx] = self.group[ref]
            if ref < 0:
                leaf[idx] = -1 - ref
                continue
            near = _distance(s[idx], self.centres[ref, 0]) <= _distance(s[idx], self.centres[ref, 1])
            stack += [(int(self.child[ref, 0]), idx[near]), (int(self.child[ref, 1]), idx[~near])]
        return leaf, grp, np.abs(s - self.homes[grp]).sum(axis=1).astype(np.int32)

    def reach(self, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Which groups may hold a vector within ``r`` of each query: a boolean per (query, group)."""
        out = np.zeros((len(s), len(self.homes)), dtype=bool)
        stack = [(0 if len(self.child) else -1, np.arange(len(s)))]
        while stack:
            ref, idx = stack.pop()
            if not len(idx):
                continue
            if ref in self.group:
                out[idx, self.group[ref]] = True
                continue
            gap = _distance(s[idx], self.centres[ref, 0]) - _distance(s[idx], self.centres[ref, 1])
            stack += [(int(self.child[ref, 0]), idx[gap <= 2 * r[idx]]), (int(self.child[ref, 1]), idx[-gap <= 2 * r[idx]])]
        return out

    def pack(self) -> bytes:
        held = io.BytesIO()
        np.savez_compressed(held, centres=self.centres, child=self.child, top=self.top)
        return held.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> CentreTree:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        return cls(x["centres"], x["child"], x["top"])


def radius(n: np.ndarray) -> np.ndarray:
    """The farthest a match of a vector of ``n`` coordinates can be, whatever its own length."""
    return 2 * (n // NEED_DEN) + 1


def placed(vecs: DataFrame, tree) -> DataFrame:
    """Vectors with short forms, leaf, group and ring. ``tree``: the broadcast centres."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            flat, starts = _flat(pdf["vec"])
            leaf, grp, ring = tree.value.place(_folded((flat >> 16) & (WIDTH - 1), starts, WIDTH))
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "sig": pdf["sig"], "near_a": _nibbles(flat, starts, 24), "near_b": _nibbles(flat, starts, 28), "leaf": leaf, "grp": grp, "ring": ring, "vec": pdf["vec"]})

    return vecs.select("id", "n", "sig", "vec").mapInPandas(run, VECTOR)


def _boxes(cells: DataFrame, gen: int) -> DataFrame:
    """The directory rows of vectors that have a ``cell``, sorted by it. A cell that lies across two batches gets a row for each part."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("cell", kind="stable")
            cell, first = np.unique(pdf["cell"].to_numpy(), return_index=True)
            flat, starts = _flat(pdf["vec"])
            sizes = np.diff(np.append(starts, len(flat)))
            at = np.repeat(np.repeat(np.arange(len(cell)), np.diff(np.append(first, len(pdf)))), sizes)
            bits = np.zeros((len(cell), 1 << BOX), dtype=np.uint8)
            bits[at, flat & ((1 << BOX) - 1)] = 1
            by = pdf.groupby("cell", sort=True)
            lo, hi = by[["n", "ring"]].min(), by[["n", "ring"]].max()
            yield pd.DataFrame({
                "cell": cell, "gen": np.int32(gen), "grp": by["grp"].first().to_numpy(), "held": by.size().to_numpy(), "n_lo": lo["n"].to_numpy(), "n_hi": hi["n"].to_numpy(),
                "ring_lo": lo["ring"].to_numpy(), "ring_hi": hi["ring"].to_numpy(), "box": [b.tobytes() for b in np.packbits(bits, axis=1)],
            })

    return cells.select("cell", "grp", "n", "ring", "vec").mapInPandas(run, DIRECTORY)


def _open_cells(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, cells: pd.DataFrame, trees: dict[int, CentreTree]) -> tuple[np.ndarray, np.ndarray]:
    """(query number, cell) for every cell that the bounds do not exclude. Queries: their coordinates end to end, where each starts and how many it has."""
    r, ends = radius(n), np.append(starts, len(flat))[1:]
    slots = flat & ((1 << BOX) - 1)
    s = _folded((flat >> 16) & (WIDTH - 1), starts, WIDTH)
    names, n_lo, n_hi, lo, hi = (cells[c].to_numpy(dtype=np.int64) for c in ("cell", "n_lo", "n_hi", "ring_lo", "ring_hi"))
    bits = np.ascontiguousarray(np.unpackbits(np.frombuffer(b"".join(cells["box"]), dtype=np.uint8).reshape(len(cells), -1), axis=1).T)
    telling = bits.sum(axis=1, dtype=np.int64) * 2 < len(cells)  # slots that most boxes have exclude little
    away, open_to, home = [], [], np.zeros(len(cells), dtype=np.int64)
    for gen, own in cells.groupby("gen", sort=True).indices.items():
        home[own] = len(away) + cells["grp"].to_numpy()[own]
        away += [_distance(s, c) for c in trees[gen].homes]
        open_to += list(trees[gen].reach(s, r).T)
    away, open_to = np.array(away), np.array(open_to)
    who, what = [], []
    step = max(1, 1_000_000 // len(cells))
    for a in range(0, len(n), step):
        z = slice(a, a + step)
        d, most, least = away[home, z], n[z] * NEED_DEN, n[z] * NEED_NUM
        fits = open_to[home, z] & (d - r[z] <= hi[:, None]) & (d + r[z] >= lo[:, None]) & ((n_lo * NEED_NUM)[:, None] <= most) & ((n_hi * NEED_DEN)[:, None] >= least)
        fits = np.ascontiguousarray(fits.T)
        for j in np.nonzero(fits.any(axis=1))[0].tolist():
            k, fit, spare = a + j, fits[j], int(n[a + j]) // NEED_DEN
            mine = slots[starts[k] : ends[k]]
            mine = mine[telling[mine]]
            if len(mine) > spare:
                inside = bits[mine].sum(axis=0, dtype=np.uint8 if len(mine) < 256 else np.int32)
                fit = fit & (inside >= len(mine) - spare)
            hit = names[fit]
            if len(hit):
                what.append(hit)
                who.append(np.full(len(hit), k))
    if not who:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(who), np.concatenate(what)


def probes(queries: DataFrame, n_queries: int, directory: DataFrame, trees, top_cell: int) -> DataFrame:
    """(cell, q, q_n, q_near_a, q_near_b): the cells that each query has to look into.

    Queries and directory meet in blocks: of cells by number, of queries by hash. ``trees``: the broadcast centres by generation.
    """
    blocks = max(1, -(-top_cell // BLOCK))
    # small batches are divided over the cores too
    salts = max(1, -(-n_queries // PART), min(queries.sparkSession.sparkContext.defaultParallelism, -(-n_queries // 512)))
    spread = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    d = directory.withColumn("block", F.floor(F.col("cell") / BLOCK).cast("int"))
    if blocks > 1:
        held = d.select(F.col("block").alias("to"), "gen", "grp").distinct()  # which groups a block has: at most groups x blocks rows
        q = _groups_in_reach(queries, trees).withColumn("salt", spread)
        q = q.join(held, ["gen", "grp"]).drop("gen", "grp").dropDuplicates(["id", "to"])
    else:
        q = queries.select("id", "n", "near_a", "near_b", "vec").withColumn("salt", spread).withColumn("to", F.lit(0))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, dtype=np.int64)
        i, cell = none, none
        if len(a) and len(b):
            flat, starts = _flat(a["vec"])
            i, cell = _open_cells(flat, starts, a["n"].to_numpy(dtype=np.int64), b, trees.value)
        out = a[["id", "n", "near_a", "near_b"]].iloc[i]
        return pd.DataFrame({"cell": cell, "q": out["id"].to_numpy(), "q_n": out["n"].to_numpy(), "q_near_a": out["near_a"].to_numpy(), "q_near_b": out["near_b"].to_numpy()})

    met = q.groupBy("to", "salt").cogroup(d.groupBy("block", "part"))
    return met.applyInPandas(run, "cell long, q long, q_n int, q_near_a long, q_near_b long")


def _groups_in_reach(queries: DataFrame, trees) -> DataFrame:
    """Each query once per (gen, grp) that may hold a match of it."""

    @F.pandas_udf("array<struct<gen:int,grp:int>>")
    def groups(n: pd.Series, vec: pd.Series) -> pd.Series:
        s, r = sketches(vec), radius(n.to_numpy(dtype=np.int64))
        out: list[list[dict]] = [[] for _ in range(len(n))]
        for gen, tree in trees.value.items():
            for i, g in zip(*np.nonzero(tree.reach(s, r))):
                out[i].append({"gen": int(gen), "grp": int(g)})
        return pd.Series(out)

    return queries.select("id", "n", "near_a", "near_b", "vec", F.explode(groups("n", "vec")).alias("x")).select("id", "n", "near_a", "near_b", "vec", "x.gen", "x.grp")


def _short_distance(a: str, b: str) -> str:
    return " + ".join(f"abs(cast(shiftrightunsigned({a}, {4 * k}) & 15 as int) - cast(shiftrightunsigned({b}, {4 * k}) & 15 as int))" for k in range(16))


_NEED = f"greatest(n, q_n) * {NEED_NUM}"
# vectors near enough are at most this far apart, and their short forms no farther
_REACH = f"n + q_n - 2 * ceil({_NEED} / {NEED_DEN})"
_MAY_MATCH = f"least(n, q_n) * {NEED_DEN} >= {_NEED} and {_short_distance('near_a', 'q_near_a')} <= {_REACH} and {_short_distance('near_b', 'q_near_b')} <= {_REACH}"


def rerank(probed: DataFrame, n_probes: int | None, stored: DataFrame, queries: DataFrame, ordered: bool) -> DataFrame:
    """(id_a, id_b) of stored vectors in probed cells that are near enough to the query by their full vectors.

    Up to ``FEW`` probes, if counted, are broadcast, so that stored vectors are read but not shuffled; others are joined as the optimizer sees fit.
    """
    p = F.broadcast(probed) if n_probes is not None and n_probes <= FEW else probed
    cond = _MAY_MATCH
    if ordered:
        cond = f"id < q and {cond}"
    x = stored.select("cell", "id", "n", "near_a", "near_b", "vec").join(p, "cell").where(cond).select("id", "n", "vec", "q", "q_n")
    x = x.join(queries.select(F.col("id").alias("q"), F.col("vec").alias("q_vec")), "q")
    overlap = F.size(F.array_intersect("vec", "q_vec"))
    return x.where(overlap * NEED_DEN >= F.greatest("n", "q_n") * NEED_NUM).select(F.col("id").alias("id_a"), F.col("q").alias("id_b")).distinct()


def _settled(batches):
    """(kept, dup) from pairs in order of id_b, id_a: the fate of id_a, the smaller one, is known when a pair comes."""
    gone: set[int] = set()
    last = None
    for pdf in batches:
        kept, dup = [], []
        for a, b in zip(pdf["id_a"].tolist(), pdf["id_b"].tolist()):
            if b != last and a not in gone:
                kept.append(a)
                dup.append(b)
                gone.add(b)
                last = b
        yield pd.DataFrame({"kept": pd.Series(kept, dtype="int64"), "dup": pd.Series(dup, dtype="int64")})


def settle(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Accept in order of id: a row is turned away if an accepted earlier row is near it, for the smallest such row.

    Up to ``SETTLED_AT_ONCE`` pairs, counted, go through one sorted pass; more are settled in rounds of joins.
    """
    n = edges.count()
    if not n:
        return None
    if n <= SETTLED_AT_ONCE:
        return scratch.keep(edges.repartition(1).sortWithinPartitions("id_b", "id_a").mapInPandas(_settled, "kept long, dup long"), "settled")
    struck = None
    while True:
        open_edges = edges
        if struck is not None:  # pairs with a row already turned away say nothing more
            open_edges = edges.join(struck, edges["id_a"] == struck["d"], "left_anti").join(struck, edges["id_b"] == struck["d"], "left_anti")
        roots = open_edges.select(F.col("id_a").alias("r")).distinct().join(open_edges.select(F.col("id_b").alias("r")).distinct(), "r", "left_anti")
        hit = scratch.keep(open_edges.join(roots, open_edges["id_a"] == roots["r"], "left_semi").select(F.col("id_b").alias("d")).distinct(), "struck")
        if hit.isEmpty():
            break
        struck = hit if struck is None else struck.union(hit)
    if struck is None:
        return None
    # a smaller neighbour may have been accepted in a later round than the one that struck the row
    found = edges.join(struck, edges["id_b"] == struck["d"], "left_semi").join(struck, edges["id_a"] == struck["d"], "left_anti")
    return scratch.keep(found.groupBy(F.col("id_b").alias("dup")).agg(F.min("id_a").alias("kept")).select("kept", "dup"), "settled")


def slices(reps: DataFrame, total: int, first: int, growth: int):
    """(rows, about how many, the id all earlier slices end with) in order of id, slices growing by ``growth``."""
    if total <= first * growth:
        yield reps, total, None
        return
    shares, at = [], first
    while at * growth < total * 2:
        shares.append(at / total)
        at *= growth
    cuts = reps.approxQuantile("id", shares, 0.0005)
    edges = [None, *cuts, None]
    for lo, hi, share in zip(edges, edges[1:], [*shares, 1.0]):
        part = reps
        if lo is not None:
            part = part.where(F.col("id") > lo)
        if hi is not None:
            part = part.where(F.col("id") <= hi)
        yield part, max(1, int(share * total)), lo


class RareFirst:
    """The order of coordinates, by how many of ``total`` vectors hold each. Those not listed are held by ``least`` or fewer."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, least: int, total: int):
        by = np.argsort(keys)
        self.keys, self.counts = np.append(keys[by], np.iinfo(np.int64).max), np.append(counts[by], 0).astype(np.float64)
        self.least, self.total, self.light, self.long = float(least), float(total), LIGHT, LONG

    @classmethod
    def of(cls, vecs: DataFrame, total: int) -> RareFirst:
        """Counted over all vectors; the ``KNOWN`` most frequent coordinates are listed, which only decides how much is compared."""

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x, c = np.unique(_flat(pdf["vec"])[0], return_counts=True)
                    yield pd.DataFrame({"x": x, "c": c})

        least = max(1, min(16, LIGHT // 8))
        held = vecs.select("vec").mapInPandas(run, "x long, c long").groupBy("x").agg(F.sum("c").alias("c")).where(F.col("c") > least)
        top = held.orderBy(F.col("c").desc(), "x").limit(KNOWN).toPandas()
        return cls(top["x"].to_numpy(dtype=np.int64), top["c"].to_numpy(dtype=np.int64), int(top["c"].min()) if len(top) == KNOWN else least, total)

    def signatures(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the vector, signature), in order of the vectors. Different vectors that match have at least one in common.

        Vectors of fewer than 7 coordinates match no other. Those of more than ``LONG`` are not drawn out; the ones just below
        are given both ways, as their matches may be longer.
        """
        sizes = np.diff(np.append(starts, len(flat)))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(self.keys, flat)
        c = np.where(self.keys[at] == flat, self.counts[at], self.least)
        by = np.lexsort((flat, c, owner))
        x, c = flat[by].astype(np.uint64), c[by]
        n = sizes[owner]
        reach = starts[owner] + n // NEED_DEN  # the last place of the first shared coordinate
        one = np.nonzero((np.arange(len(x)) <= reach) & (n >= NEED_NUM))[0]
        key = _mixed(x[one] + np.uint64(_STEP))
        whole = n[one] * NEED_DEN > self.long * NEED_NUM
        who, keys = [owner[one[whole]]], [_mixed(key[whole])]
        drawn = n[one] <= self.long
        last, key, few = one[drawn], key[drawn], c[one[drawn]]
        for depth in range(1, DEEP + 1):
            done = (few <= self.light) | (depth == DEEP)
            who.append(owner[last[done]])
            keys.append(key[done])
            last, key, few = last[~done], key[~done], few[~done]
            more = np.maximum(reach[last] + depth - last, 0)
            upto = np.cumsum(more)
            step = np.arange(int(more.sum())) - np.repeat(upto - more, more) + 1
            last, key, few = np.repeat(last, more) + step, np.repeat(key, more), np.repeat(few, more)
            key = _mixed(key + x[last] * np.uint64(_STEP))
            few = few * c[last] / self.total
        who, keys = np.concatenate(who), np.concatenate(keys)
        by = np.argsort(who, kind="stable")
        return who[by], keys[by].astype(np.int64)


def signed(vecs: DataFrame, order) -> DataFrame:
    """(id, n, odd_a, odd_b, keys): parities and signatures of vectors. ``order``: the broadcast order of coordinates."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            flat, starts = _flat(pdf["vec"])
            who, key = order.value.signatures(flat, starts)
            ends = np.searchsorted(who, np.arange(1, len(pdf) + 1)).tolist()
            keys = pd.Series([key[a:b] for a, b in zip([0, *ends], ends)], dtype="object")
            odd = _parities(flat, starts)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n": pdf["n"].to_numpy(), "odd_a": odd[:, 0], "odd_b": odd[:, 1], "keys": keys})

    return vecs.select("id", "n", "vec").mapInPandas(run, "id long, n int, odd_a long, odd_b long, keys array<bigint>")


def near_pairs(older: DataFrame, newer: DataFrame, vecs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id_a, id_b) of signed vectors of ``older`` and later ones of ``newer`` that say the same, by their full vectors."""
    a = older.select("id", "n", "odd_a", "odd_b", F.explode("keys").alias("key"))
    b = newer.select(F.col("id").alias("q"), F.col("n").alias("q_n"), F.col("odd_a").alias("q_odd_a"), F.col("odd_b").alias("q_odd_b"), F.explode("keys").alias("key"))
    # every coordinate that only one of the two has turns one parity over
    may = f"id < q and least(n, q_n) * {NEED_DEN} >= {_NEED} and bit_count(odd_a ^ q_odd_a) + bit_count(odd_b ^ q_odd_b) <= {_REACH}"
    found = scratch.keep(a.join(b, "key").where(may).select(F.col("id").alias("id_a"), F.col("q").alias("id_b")).distinct(), "candidates")
    p = F.broadcast(found) if found.count() <= FEW else found  # counted, as in rerank
    x = p.join(vecs.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("vec").alias("vec_a")), "id_a")
    y = p.join(vecs.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("vec").alias("vec_b")), "id_b")
    overlap = F.size(F.array_intersect("vec_a", "vec_b"))
    return x.join(y, ["id_a", "id_b"]).where(overlap * NEED_DEN >= F.greatest("n_a", "n_b") * NEED_NUM).select("id_a", "id_b")


def deduplicate_in_order(df: DataFrame, id_col: str, text_col: str, first: int = 4096, growth: int = 8) -> DataFrame:
    """(kept_id, dup_id) of all rows, taken in order of their ids, which are unique.

    Rows are taken in slices that grow by ``growth``: those that repeat an accepted row of an earlier slice are put aside
    before the rest is compared among itself, so a group of alike rows is not compared pairwise.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        vecs = scratch.keep(vectors(spread_out(df.select(id_col, text_col)), id_col, text_col), "vectors")
        reps = scratch.keep(vecs.groupBy("sig").agg(F.min("id").alias("rep")), "firsts")  # one vector per text; later copies follow its fate
        order = spark.sparkContext.broadcast(RareFirst.of(vecs, vecs.count()))  # at most KNOWN coordinates and their counts
        rows = scratch.keep(signed(vecs, order).join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), "signed")
        fate = None
        for part, _, lo in slices(rows, rows.count(), first, growth):
            if lo is not None:
                accepted = rows.where(F.col("id") <= lo)
                if fate is not None:
                    accepted = accepted.join(fate.select(F.col("dup").alias("id")), "id", "left_anti")
                old = near_pairs(accepted, part, vecs, scratch).groupBy(F.col("id_b").alias("dup")).agg(F.min("id_a").alias("kept")).select("kept", "dup")
                old = scratch.keep(old, "old")
                part = part.join(old.select(F.col("dup").alias("id")), "id", "left_anti")
                fate = old if fate is None else fate.unionByName(old)
            new = settle(scratch.keep(near_pairs(part, part, vecs, scratch), "edges"), scratch)
            if new is not None:
                fate = new if fate is None else fate.unionByName(new)
        out = vecs.select("id", "sig").join(reps, "sig")
        kept = F.col("rep")
        if fate is not None:
            out, kept = out.join(fate, out["rep"] == fate["dup"], "left"), F.coalesce("kept", "rep")
        done = fresh_path(spark, "fates")
        out.where(kept != F.col("id")).select(kept.alias("kept_id"), F.col("id").alias("dup_id")).write.parquet(done)
        return spark.read.schema("kept_id long, dup_id long").parquet(done)


class HistoryIndex:
    """The persisted cells, directory and centres of all accepted rows.

    ``ingest`` takes a batch whose ids are larger than all ids taken before and returns
    (kept_id, dup_id) for the rows to turn away. Batches above ``first`` rows are taken in
    slices that grow by ``growth``, so that a group of alike rows is represented in the
    history before most of its rows arrive and is never compared pairwise.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, first: int = 4096, growth: int = 8, cell_rows: int = 8, cells_per_file: int = 2048):
        self.spark = spark
        self.path = path or fresh_path(spark, "history")
        self.first, self.growth = first, growth
        self.cell_rows, self.cells_per_file = cell_rows, cells_per_file
        self.trees: dict[int, CentreTree] = {}
        self.rows = self.rows_at_fit = self.next_cell = 0
        self.files_read: list[str] = []  # files of vectors read for the last batch
        if path and path_exists(spark, f"{path}/centres"):
            for gen, rows, data in spark.read.parquet(f"{path}/centres").collect():  # one row per generation
                self.trees[gen] = CentreTree.unpack(bytes(data))
                self.rows_at_fit = max(self.rows_at_fit, rows)
            if path_exists(spark, f"{path}/cells"):
                held, top = spark.read.parquet(f"{path}/cells").agg(F.sum("held"), F.max("cell")).first()
                self.rows, self.next_cell = int(held or 0), self._file_start(int(top) + 1) if top is not None else 0
        self._held = None

    def _file_start(self, cell: int) -> int:
        return -(-cell // self.cells_per_file) * self.cells_per_file

    def _shared(self):
        if self._held is None:
            self._held = self.spark.sparkContext.broadcast(self.trees)  # a few trees of at most 2**DEPTH nodes
        return self._held

    def fit(self, vecs: DataFrame) -> None:
        """Further centres, from at most ``SAMPLE`` distinct vectors, taken in order of a hash."""
        rows = vecs.select("sig", "vec").orderBy(F.xxhash64("sig"), "sig").limit(SAMPLE).dropDuplicates(["sig"]).select("vec").toPandas()
        gen = len(self.trees)
        self.trees[gen] = CentreTree.fit(sketches(rows["vec"]))
        self.rows_at_fit = max(self.rows, len(rows))
        self.spark.createDataFrame([(gen, self.rows_at_fit, bytearray(self.trees[gen].pack()))], "gen int, rows long, data binary").coalesce(1).write.mode("append").parquet(f"{self.path}/centres")
        self._held = None

    def ingest(self, batch: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(kept_id, dup_id); what is written beside the index itself is removed with the next batch or ``close``."""
        self.files_read = []
        with Scratch(self.spark) as scratch:
            vecs = scratch.keep(vectors(batch, id_col, text_col), "vectors")
            nothing = self.spark.createDataFrame([], "kept_id long, dup_id long")
            # one vector per text; later copies follow its fate
            if not self.trees or self.rows >= REFIT * self.rows_at_fit:
                if vecs.isEmpty():
                    return nothing
                self.fit(vecs)
            firsts = vecs.groupBy("sig").agg(F.min("id").alias("id"))
            firsts = vecs.join(firsts, ["sig", "id"], "left_semi").dropDuplicates(["id"])
            reps = scratch.keep(placed(firsts, self._generation()), "placed")
            total = reps.count()
            if not total:
                return nothing
            fate = None
            for part, size in self._slices(reps, total):
                f = self._ingest_slice(part, size, scratch)
                fate = f if fate is None else fate.unionByName(f)
            rep_of = vecs.select("id", "sig").distinct().join(reps.select("sig", F.col("id").alias("rep")), "sig")
            out = rep_of.join(fate, rep_of["rep"] == fate["dup"], "left")
            kept = F.coalesce("kept", "rep")
            out = out.where(kept != F.col("id")).select(kept.alias("kept_id"), F.col("id").alias("dup_id"))
            done = fresh_path(self.spark, "fates")
            out.write.parquet(done)
            return self.spark.read.schema("kept_id long, dup_id long").parquet(done)

    def _generation(self):
        return self.spark.sparkContext.broadcast(self.trees[len(self.trees) - 1])

    def _slices(self, reps: DataFrame, total: int):
        for part, size, _ in slices(reps, total, self.first, self.growth):
            yield part, size

    def _in_cells(self, rest: DataFrame) -> DataFrame:
        """``rest`` with its new cells: leaves of the tree, small neighbours in a group together, large ones divided by hash."""
        counts = rest.groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("c")).orderBy("grp", "leaf").collect()  # one row per leaf, at most 2**DEPTH
        at, rows, fill, last = self.next_cell - 1, [], 0, None
        for grp, leaf, c in counts:
            if c <= self.cell_rows:
                if grp != last or fill + c > self.cell_rows:
                    at, fill = at + 1, 0
                rows.append((leaf, at, 1))
                fill += c
            else:
                parts = -(-c // self.cell_rows)
                rows.append((leaf, at + 1, parts))
                at, fill = at + parts, self.cell_rows
            last = grp
        self.next_cell = self._file_start(at + 1)
        self.rows += sum(r[2] for r in counts)
        table = self.spark.createDataFrame(rows, "leaf int, first long, parts long")
        return rest.join(F.broadcast(table), "leaf").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("id"), "parts")).drop("first", "parts")

    def _ingest_slice(self, reps: DataFrame, size: int, scratch: Scratch) -> DataFrame:
        """(kept, dup) for the distinct vectors of a slice; the accepted ones are appended."""
        spark = self.spark
        cells = f"{self.path}/cells"
        none = spark.createDataFrame([], "kept long, dup long")
        fate, rest = None, reps
        if self.rows:
            probed = scratch.keep(probes(reps, size, spark.read.schema(f"{DIRECTORY}, `from` long").parquet(cells), self._shared(), self.next_cell), "probes")
            per_file = probed.groupBy(F.floor(F.col("cell") / self.cells_per_file).alias("f")).count().collect()  # one row per file of the index
            if per_file:
                files = [f"{self.path}/vectors/file={r[0]}" for r in per_file]
                self.files_read += files
                stored = spark.read.schema(f"{VECTOR}, cell long").parquet(*files)
                hits = rerank(probed, sum(r[1] for r in per_file), stored, reps, False)
                fate = scratch.keep(hits.groupBy(F.col("id_b").alias("dup")).agg(F.min("id_a").alias("kept")).select("kept", "dup"), "old")
                rest = reps.join(fate.select(F.col("dup").alias("id")), "id", "left_anti")
        base = self.next_cell
        fresh = scratch.keep(self._in_cells(rest).repartition("cell").sortWithinPartitions("cell"), "fresh")
        slice_cells = f"{cells}/from={base}"
        _boxes(fresh, len(self.trees) - 1).write.mode("overwrite").parquet(slice_cells)
        # the slice against itself, cells numbered from 0
        shifted = spark.read.schema(DIRECTORY).parquet(slice_cells).withColumn("cell", F.col("cell") - base)
        own = probes(fresh, size, shifted, self._shared(), self.next_cell - base).withColumn("cell", F.col("cell") + base)
        new = self._settle(scratch.keep(rerank(own, None, fresh, fresh, True), "edges"), scratch)
        if new is not None:
            fate = new if fate is None else fate.unionByName(new)
            fresh = fresh.join(new.select(F.col("dup").alias("id")), "id", "left_anti")
        # boxes may still hold coordinates of rows turned away just now: looser, never wrong
        fresh = fresh.withColumn("file", F.floor(F.col("cell") / self.cells_per_file))
        fresh.repartition("file").sortWithinPartitions("file", "cell").write.mode("append").partitionBy("file").parquet(f"{self.path}/vectors")
        return none if fate is None else fate

    def _settle(self, edges: DataFrame, scratch: Scratch) -> DataFrame | None:
        return settle(edges, scratch)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def deduplicate_batches(df: DataFrame, batch_col: str, id_col: str, text_col: str, index: HistoryIndex | None = None) -> DataFrame:
    """(kept_id, dup_id) over all batches of ``df``, in their order.

    Without an index, batches whose unique ids rise from batch to batch are taken in one pass; others go through an index one after the other,
    which is removed at the end if it was not passed in.
    """
    spark = df.sparkSession
    own = index is None
    if own and _in_order(df, batch_col, id_col):
        return deduplicate_in_order(df, id_col, text_col)
    index = index or HistoryIndex(spark)
    numbers = [r[0] for r in df.select(batch_col).distinct().orderBy(F.col(batch_col).asc_nulls_last()).collect()]  # one value per delivery
    found = None
    for b in numbers:
        # each batch's result is written at once, so no plan spans batches
        f = index.ingest(df.where(F.col(batch_col).eqNullSafe(F.lit(b))), id_col, text_col)
        found = f if found is None else found.unionByName(f)
    if own:
        index.drop()
    return spark.createDataFrame([], "kept_id long, dup_id long") if found is None else found


def _in_order(df: DataFrame, batch_col: str, id_col: str) -> bool:
    """Whether every batch's ids are larger than those of the batches before it and no id is repeated."""
    ids = df.select(F.col(batch_col).alias("b"), F.col(id_col).cast("long").alias("i")).where("i is not null")
    spans = ids.groupBy("b").agg(F.min("i"), F.max("i")).orderBy(F.col("b").asc_nulls_last()).collect()  # one row per delivery
    return all(x[2] < y[1] for x, y in zip(spans, spans[1:])) and ids.groupBy("i").count().where("count > 1").isEmpty()
