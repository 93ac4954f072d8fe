"""Records of evaluation splits that also appear in the training split (problem 2).

Both sides are folded to letters and digits. An evaluation text of length L may differ from a
training text by k edits, k an eighth of the longer one. An edit spoils at most one of the passages
a text is cut into and moves the others by one place at most, so a match keeps all but k passages, each
within k places of its own.

Evaluation texts are divided into shards by length, of ``SHARD_LETTERS`` letters at most, a text counted as
``LEAST_LETTERS`` at least. A training text is sent to the shards whose lengths it can match, and only there. Shards meet
their training texts in tasks of at most about ``TASK_LETTERS`` training letters; nothing is collected or broadcast but the
lengths' histogram (one row per length). In a task, a table of bits says which evaluation texts hold
which ``PROBE`` letters and about where. A training text is cut into passages of ``PROBE`` letters,
of which all but k must be held: the bits of its passages are added up for 64 evaluation texts at once, first by blocks
of like texts, then by text, there only for the k + ``LEFT`` rarest passages. Collisions and wide bands only add to a sum, so no match
is lost. For the few pairs left a bound on letter pairs (an edit changes two of them), the passages of the evaluation text
and a bit-parallel edit distance decide.

Each link keeps which passages of the evaluation text were matched in place; of those there is one more than the most edits any
partner allows, evenly spread, of at most ``GRAM`` letters each. They are merged into the coverage of the evaluation record.

Defined cases: null, blank and letterless texts never match; equal texts are compared once
per distinct text and expanded to their rows; texts of fewer than two passages are looked up whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.folding import fold_letters
from quillspark.operators.spread import salted_join
from quillspark.session import materialize

GRAM = 6
PROBE = 4
PAIRS = 512
LEFT = 24
BLOCK = 2
MORE = 5
TOGETHER = 4096
PIECE_LETTERS = 500_000
BATCH_WORDS = 150_000
SHARD_LETTERS = 16_000_000
TASK_LETTERS = 64_000_000
LEAST_LETTERS = 100


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(fold_letters)


def allowed(length: int) -> int:
    return length // 8


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is larger; Myers' bit vectors over Python integers."""
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = _skip(a, b)
    n = len(a)
    if abs(n - len(b)) > most:
        return most + 1
    if not n or not b:
        return max(n, len(b))
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, left = full, 0, n, len(b)
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return score if score <= most else most + 1


def _skip(a: str, b: str) -> tuple[str, str]:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:], b[i:]


def same(a: str, b: str) -> bool:
    most = allowed(max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each neighbouring pair of letters occurs in each text, in ``PAIRS`` slots; counts end at 255, which brings no two further apart."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    slot = (c[:-1] * np.uint32(31) + c[1:]) % np.uint32(PAIRS)
    inside = owner[:-1] == owner[1:]
    return np.minimum(np.bincount(owner[:-1][inside] * PAIRS + slot[inside], minlength=len(texts) * PAIRS), 255).astype(np.uint8).reshape(len(texts), PAIRS)


def _nearest(pairs: np.ndarray, length: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre closest to each text's share of letter pairs."""
    if not len(centres):
        return np.zeros(len(pairs), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(pairs[k : k + 4096] / length[k : k + 4096, None].astype(np.float32) @ centres.T - half).argmax(axis=1) for k in range(0, len(pairs), 4096)])


def _centres(pairs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Centres of texts alike in letter pairs, from at most 2,048 of them; they order the texts and decide nothing."""
    some = np.linspace(0, len(pairs) - 1, min(len(pairs), 2048)).astype(np.int64)
    share = pairs[some] / length[some, None].astype(np.float32)
    centres = share[:: max(1, len(share) // max(1, min(32, len(pairs) // 512)))][:32] if len(pairs) >= 1024 else share[:0]
    for _ in range(4 if len(centres) else 0):
        near = _nearest(pairs[some], length[some], centres)
        centres = np.stack([share[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each window of ``PROBE`` letters."""
    n = max(0, len(codes) - PROBE + 1)
    h = np.zeros(n, dtype=np.uint32)
    for i in range(PROBE):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[i : n + i] * np.uint32(0x9E3779B1)
    return h


def _row_of(h: np.ndarray, band: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) + band.astype(np.uint32) * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, position) of every window of ``PROBE`` letters that lies in one text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    h = _gram_hashes(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    pos = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner]
    inside = pos <= sizes[owner] - PROBE
    return h[inside], owner[inside], pos[inside]


def add_up(bits: np.ndarray) -> list[np.ndarray]:
    """How many of the rows of ``bits`` have each bit set, as binary digits, lowest first; overwrites ``bits``."""
    digits, have = [], [bits]
    while have:
        x = have[0] if len(have) == 1 else np.concatenate(have)
        have = []
        while len(x) > 2:
            t = len(x) // 3
            a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
            u = a ^ b
            a &= b
            np.bitwise_and(u, c, out=b)
            a |= b
            c ^= u
            have.append(a)
            x = x[2 * t :]
        if len(x) == 2:
            have.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        digits.append(x[0])
    return digits


def _enough(table: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The bits that are set in ``most`` rows of ``table`` at least, of those named along the first axis of ``at``."""
    digits = add_up(table.take(at, axis=0))
    if most.bit_length() > len(digits):
        return np.zeros_like(digits[0])
    out = np.full(digits[0].shape, ~np.uint64(0))
    for i, d in enumerate(digits):
        if most >> i & 1:
            out &= d
        else:
            out |= d
    return out


def _lists(names, row: np.ndarray, start: np.ndarray, count: np.ndarray, need: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The rows of some texts side by side, and how many each bit must have; made up with empty rows, and with full ones to need as many."""
    names = list(names)
    most = int(need[names].max())
    at = np.full((int((count[names] + most - need[names]).max()), len(names)), n - 2)
    for j, k in enumerate(names):
        at[: count[k], j] = row[start[k] : start[k] + count[k]]
        at[count[k] : count[k] + most - need[k], j] = n - 1
    return at, most


class PassageShard:
    """Which evaluation texts of one shard hold which ``PROBE`` letters, and about where, as one bit per text.

    A row of bits stands for a hash of ``PROBE`` letters and a band of positions; a text sets the rows of all its letters in
    all bands within its reach. Texts alike in letter pairs are held together, in blocks of ``BLOCK`` words of bits; a
    block is passed over if its lengths are out of reach or all its texts taken together hold too few passages.
    """

    def __init__(self, ids: list[int], texts: list[str]):
        length = np.array([len(t) for t in texts], dtype=np.int64)
        step = max(1, min(1024, 1_000_000 // int(length.max(initial=1))))
        pairs = np.concatenate([pair_counts(texts[k : k + step]) for k in range(0, len(texts), step)]) if texts else np.zeros((0, PAIRS), dtype=np.uint8)
        self.centres = _centres(pairs, length)
        by = np.lexsort((length, _nearest(pairs, length, self.centres)))
        self.ids, self.texts = [ids[i] for i in by], [texts[i] for i in by]
        self.length, self.pairs = length[by], pairs[by]
        self.most = self.length * 8 // 7 // 8  # edits allowed with the longest partner
        self.band = int(self.most.max(initial=0)) + 1
        self.bits = min(22, max(10, int(32 * self.length.mean()).bit_length())) if texts else 10
        words = -(-len(texts) // 64)
        self.block = max(1, min(BLOCK, words))
        n = -(-words // self.block)
        self.rows = np.zeros(((1 << self.bits) + 2) * n * self.block, dtype=np.uint64)
        wide = -(-n // 64)
        self.wide_bits = min(22, self.bits + MORE)
        self.some = np.zeros(((1 << self.wide_bits) + 2) * wide, dtype=np.uint64)  # a bit per block, for all positions
        for b in range(min(64, len(texts))):
            h, owner, pos = _laid_out(self.texts[b::64])
            group = owner // self.block
            np.bitwise_or.at(self.some, _row_of(h, np.zeros_like(pos), self.wide_bits) * wide + (group >> 6), np.uint64(1) << (group & 63).astype(np.uint64))
            reach = self.most[b::64][owner] + 1
            first, last = (pos - reach + self.band) // self.band, (pos + reach + self.band) // self.band
            for j in range(int((last - first).max(initial=-1)) + 1):
                z = first + j <= last
                # within one bit no two texts share a word
                self.rows[_row_of(h[z], first[z] + j, self.bits) * (n * self.block) + owner[z]] |= np.uint64(1 << b)
        self.rows, self.some = self.rows.reshape(-1, n, self.block), self.some.reshape(-1, wide)
        self.held = np.concatenate([np.bitwise_count(self.rows[k : k + 1024]).sum(axis=(1, 2), dtype=np.int64) for k in range(0, len(self.rows), 1024)])
        self.rows[-1], self.some[-1] = ~np.uint64(0), ~np.uint64(0)  # the last rows are full, those before them empty
        step = 64 * self.block
        self.least = np.array([self.length[k * step : (k + 1) * step].min() for k in range(n)], dtype=np.int64)
        self.longest = np.array([self.length[k * step : (k + 1) * step].max() for k in range(n)], dtype=np.int64)
        self.tiny: dict[str, list[int]] = defaultdict(list)
        for i in np.nonzero(self.length <= 2 * PROBE)[0].tolist():
            t = self.texts[i]
            for v in {t, *(t[:k] + t[k + 1 :] for k in range(len(t)) if len(t) == 2 * PROBE)}:
                self.tiny[v].append(i)

    def scan(self, texts: list[str]) -> list[tuple[int, int, list[int]]]:
        """(evaluation id, number of the text, places of the matched passages) for all matches of some training texts, scanned together."""
        out: list[tuple[int, int, list[int]]] = []
        if not self.texts:
            return out
        piece: list[int] = []
        letters = 0
        shortest, longest = int(self.length.min()), int(self.length.max())
        for k, t in enumerate(texts):
            if len(t) < 2 * PROBE:  # one edit at most, and only against 2 * PROBE letters
                out += self._decided(k, t, self.tiny.get(t, ()))
            elif shortest - shortest // 8 <= len(t) and len(t) - len(t) // 8 <= longest:
                piece.append(k)
                letters += len(t)
                if letters > PIECE_LETTERS:
                    out += self._scan(piece, [texts[i] for i in piece])
                    piece, letters = [], 0
        if piece:
            out += self._scan(piece, [texts[i] for i in piece])
        return sorted(out, key=lambda m: m[1])

    def _scan(self, names: list[int], texts: list[str]) -> list[tuple[int, int, list[int]]]:
        size = np.array([len(t) for t in texts], dtype=np.int64)
        pairs = pair_counts(texts)
        by = np.lexsort((size, _nearest(pairs, size, self.centres)))
        names, texts, size, pairs = [names[i] for i in by], [texts[i] for i in by], size[by], pairs[by]
        h, owner, pos = _laid_out(texts)
        row = _row_of(h, (pos + self.band) // self.band, self.bits)
        wide = _row_of(h, np.zeros_like(pos), self.wide_bits)
        # passages start at one of PROBE offsets, the one whose passages are rarest against the number that must be left
        edits = np.maximum(size, np.minimum(size * 8 // 7, self.length.max())) // 8
        cost = np.bincount(owner * PROBE + pos % PROBE, weights=self.held[row], minlength=len(texts) * PROBE).reshape(-1, PROBE)
        left = (size[:, None] - np.arange(PROBE)) // PROBE - edits[:, None]
        offset = np.where(left > 0, cost / np.maximum(left, 1), np.inf).argmin(axis=1)
        need = left[np.arange(len(texts)), offset]
        mine = pos % PROBE == offset[owner]
        owner, row, wide = owner[mine], row[mine], wide[mine]
        count = need + edits
        start = np.cumsum(count) - count
        open_ = np.zeros((len(texts), len(self.least)), dtype=bool)
        at = 0
        while at < len(texts):
            fit = np.maximum.accumulate(count[at:]) * np.arange(1, len(texts) - at + 1) * self.some.shape[1] <= BATCH_WORDS
            upto = at + max(1, int(fit.sum()))
            lists, most = _lists(range(at, upto), wide, start, count, need, len(self.some))
            open_[at:upto] = np.unpackbits(_enough(self.some, lists, most).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(self.least)]
            at = upto
        open_ &= (self.longest >= (size - size // 8)[:, None]) & (self.least <= (size * 8 // 7)[:, None])
        # of the rarest, as many as edits can spoil and LEFT more are counted
        row = row[np.lexsort((self.held[row], owner))]
        need = np.minimum(need, LEFT)
        count = need + edits
        out: list[tuple[int, int, list[int]]] = []
        batch: list[int] = []
        union, deep = np.zeros(open_.shape[1], dtype=bool), 0
        for k in np.nonzero(open_.any(axis=1))[0].tolist():
            wider, deeper = union | open_[k], max(deep, int(count[k]))
            if batch and deeper * (len(batch) + 1) * int(wider.sum()) * self.block > BATCH_WORDS:
                out += self._count(batch, union, names, texts, pairs, row, start, count, need)
                batch, wider, deeper = [], open_[k].copy(), int(count[k])
            batch.append(k)
            union, deep = wider, deeper
        if batch:
            out += self._count(batch, union, names, texts, pairs, row, start, count, need)
        return out

    def _count(self, batch: list[int], union: np.ndarray, names, texts, pairs, row, start, count, need) -> list[tuple[int, int, list[int]]]:
        """Matches of some training texts within some blocks: their passages are counted for 64 evaluation texts at a time."""
        lists, most = _lists(batch, row, start, count, need, len(self.rows))
        blocks = np.nonzero(union)[0]
        tile = max(1, BATCH_WORDS // (lists.size * self.block))
        flat = self.rows.reshape(-1, self.block)
        out: list[tuple[int, int, list[int]]] = []
        for z in range(0, len(blocks), tile):
            some = blocks[z : z + tile]
            enough = _enough(flat, lists[:, :, None] * len(self.least) + some, most)
            j, b, w = np.nonzero(enough)
            if not len(j):
                continue
            hit, bit = np.nonzero(np.unpackbits(enough[j, b, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            who = (some[b[hit]] * self.block + w[hit]) * 64 + bit
            j = j[hit]
            for y in range(0, len(j), 4096):
                one, two = pairs[np.array(batch)[j[y : y + 4096]]], self.pairs[who[y : y + 4096]]
                size = np.array([len(texts[batch[x]]) for x in j[y : y + 4096].tolist()])
                edits = np.maximum(self.length[who[y : y + 4096]], size) >> 3
                apart = (np.maximum(one, two) - np.minimum(one, two)).sum(axis=1, dtype=np.int64)
                for x in np.nonzero(apart <= 4 * edits)[0].tolist():
                    k = batch[j[y + x]]
                    out += self._decided(names[k], texts[k], [int(who[y + x])])
        return out

    def _decided(self, name: int, text: str, who) -> list[tuple[int, int, list[int]]]:
        n, out = len(text), []
        reach = n * 8 // 7 // 8 + 1
        for i in who:
            t = self.texts[i]
            k = max(n, len(t)) // 8
            if abs(len(t) - n) > k:
                continue
            r, size = int(self.most[i]) + 1, passage_size(len(t))
            spots = [a for a in (j * len(t) // r for j in range(r)) if text.find(t[a : a + size], max(0, a - reach), a + reach + size) >= 0]
            if len(spots) >= r - k and edit_distance(t, text, k) <= k:
                out.append((self.ids[i], name, spots))
        return out


def passage_size(length: int) -> int:
    """Letters in each passage of an evaluation text."""
    return max(1, min(GRAM, length // (length * 8 // 7 // 8 + 1)))


def shard_edges(letters: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(shortest, longest, parts): ranges of lengths with at most ``most`` letters each; a length with more is divided into parts."""
    out, lo, hi, held = [], None, None, 0
    for n in sorted(letters):
        if lo is not None and held + letters[n] > most:
            out.append((lo, hi, max(1, -(-held // most))))
            lo, held = None, 0
        lo, hi, held = n if lo is None else lo, n, held + letters[n]
    return out if lo is None else [*out, (lo, hi, max(1, -(-held // most)))]


def _links(ev: DataFrame, tr: DataFrame) -> DataFrame:
    """(eval_class, train_class, len, spots) of evaluation and training texts (cls, t, len)."""
    spark = ev.sparkSession
    by = lambda x: {r[0]: r[1] for r in x.groupBy("len").agg(F.sum(F.greatest("len", F.lit(LEAST_LETTERS)))).collect()}  # noqa: E731  one row per length
    have, against = by(ev), by(tr)
    shards = []
    edges = shard_edges(have, SHARD_LETTERS)
    cores = spark.sparkContext.defaultParallelism
    for lo, hi, parts in edges:
        least, most = lo - hi // 8 - 1, hi * 8 // 7 + 1
        salts = max(1, -(-sum(v for n, v in against.items() if least <= n <= most) // TASK_LETTERS), -(-cores // sum(e[2] for e in edges)))
        for p in range(parts):
            shards.append((len(shards), lo, hi, p, parts, least, most, salts))
    if not shards:
        return spark.createDataFrame([], "eval_class long, train_class long, len int, spots array<int>")
    plan = F.broadcast(spark.createDataFrame(shards, "shard int, lo int, hi int, part int, parts int, least int, most int, salts int"))  # one row per shard
    mine = (F.col("len") >= F.col("lo")) & (F.col("len") <= F.col("hi")) & (F.pmod(F.xxhash64("cls"), F.col("parts")) == F.col("part"))
    left = ev.join(plan, mine).select("cls", "t", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = tr.join(plan, (F.col("len") >= F.col("least")) & (F.col("len") <= F.col("most"))).select("cls", "t", F.col("shard").alias("to"), F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("part"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, n, spots = [], [], [], []
        if len(a) and len(b):
            shard = PassageShard(a["cls"].tolist(), a["t"].tolist())
            size = dict(zip(shard.ids, shard.length.tolist()))
            cls, texts = b["cls"].tolist(), b["t"].tolist()
            for k in range(0, len(texts), TOGETHER):
                for j, i, at in shard.scan(texts[k : k + TOGETHER]):
                    x.append(j)
                    y.append(cls[k + i])
                    n.append(size[j])
                    spots.append(at)
        return pd.DataFrame({"eval_class": pd.Series(x, dtype="int64"), "train_class": pd.Series(y, dtype="int64"), "len": pd.Series(n, dtype="int32"), "spots": pd.Series(spots, dtype="object")})

    return left.groupBy("shard", "salt").cogroup(right.groupBy("to", "part")).applyInPandas(run, "eval_class long, train_class long, len int, spots array<int>")


def overlaps(df: DataFrame, id_col: str, split_col: str, text_col: str, is_train: Column, is_eval: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links between classes of equal texts, evaluation members, training members).

    Links: (eval_class, train_class, len, spots), the length of the evaluation text and where its matched passages start. Members: (cls, id). A class is named by the
    smallest id among its rows of that side.
    """
    spark = df.sparkSession
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_train.alias("tr"), is_eval.alias("ev"), folded(F.col(text_col)).alias("t"))
    base = base.where("id is not null and t <> '' and (tr or ev)").withColumns({"h": F.xxhash64("t"), "g": F.xxhash64(F.lit(1), F.col("t"))})
    base = materialize(base, "folded")

    def side(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        first = rows.groupBy("h", "g").agg(F.min("id").alias("cls"), F.first("t").alias("t"))
        members = rows.select("id", "h", "g").join(first.select("h", "g", "cls"), ["h", "g"]).select("cls", "id")
        return first.select("cls", "t"), members

    ev_texts, ev_members = side(base.where("ev"))
    tr_texts, tr_members = side(base.where("tr"))
    sized = lambda x, label: materialize(x.withColumn("len", F.length("t")), label)
    return materialize(_links(sized(ev_texts, "eval"), sized(tr_texts, "train")), "links"), ev_members, tr_members


def overlap_pairs(links: DataFrame, ev: DataFrame, tr: DataFrame) -> DataFrame:
    """All (row_id_a, row_id_b) pairs of rows, smaller first."""
    # a class may hold a third of a side's rows: its members are divided over tasks, the links repeated
    e = salted_join(ev.select(F.col("cls").alias("eval_class"), F.col("id").alias("e")), links.select("eval_class", "train_class"), "eval_class", F.col("e"), salts=4)
    x = salted_join(tr.select(F.col("cls").alias("train_class"), F.col("id").alias("t")), e.select("train_class", "e"), "train_class", F.col("t"), salts=4)
    return x.select(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b")).distinct()


def overlap_report(df: DataFrame, links: DataFrame, ev: DataFrame, tr: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """Per evaluation split and source: records, records that also appear in training, and their links."""
    ev, tr = ev.distinct(), tr.distinct()
    per_class = tr.groupBy(F.col("cls").alias("train_class")).agg(F.count(F.lit(1)).alias("n"))
    found = links.join(per_class, "train_class").groupBy("eval_class").agg(F.sum("n").alias("n_pairs"))
    # passages lie apart, so the merged intervals of a record are its distinct matched passages
    r = F.floor(F.floor(F.col("len") * 8 / 7) / 8) + 1
    size = F.greatest(F.lit(1), F.least(F.lit(GRAM), F.floor(F.col("len") / r)))
    spots = links.select("eval_class", "len", F.explode("spots").alias("at")).distinct()
    covered = spots.groupBy("eval_class").agg((F.count(F.lit(1)) * F.first(size) / F.first("len")).alias("coverage"))
    found = found.join(covered, "eval_class")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source_name"))
    x = rows.join(ev, "id").join(found.withColumnRenamed("eval_class", "cls"), "cls", "left")
    return x.groupBy("split", "source_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("n_pairs").alias("n_overlapping"),
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        F.round(F.avg("coverage"), 4).alias("mean_coverage"),
    )
