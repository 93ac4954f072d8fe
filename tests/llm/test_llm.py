"""Training-data operators against brute force, round trips and the defined edge cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions.folding import fold_letters, fold_words
from quillspark.llm import bin_slack, content_scores, grouped_split, history_dedup, pair_defects, source_mix, split_overlap, token_budget, token_sizes
from quillspark.operators.spread import hot_join, spread_rank
from quillspark.session import Scratch

WORDS = [f"w{k}" for k in range(300)] + ["the", "of", "a", "Straße", "café"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shaken(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    rng.shuffle(w)
    return " ".join(w).upper() if rng.random() < 0.5 else " , ".join(w)


# ---- 1

def greedy(rows):
    held, out = [], set()
    for i, t in rows:
        c = Counter(fold_words(t))
        n = sum(c.values())
        if not n:
            continue
        hit = next((j for j, d, m in held if sum((c & d).values()) * 8 >= 7 * max(n, m)), None)
        if hit is None:
            held.append((i, c, n))
        else:
            out.add((hit, i))
    return out


def dealt(rng, n=240):
    base = [sentence(rng, rng.choice([1, 2, 3, 5, 8, 9, 16, 40])) for _ in range(40)]
    return [(i, i // 120, rng.choice([None, "", "  ...", *[shaken(rng, rng.choice(base), rng.choice([0, 0, 0.1, 0.2])) for _ in range(12)]]), 9) for i in range(n)]


def test_history_dedup_equals_greedy(spark):
    rows = dealt(random.Random(4))
    df = spark.createDataFrame(rows, "ex_id long, batch_no int, source string, vec int")
    index = history_dedup.HistoryIndex(spark, first=10, growth=3, cell_rows=3, cells_per_file=4)
    got = {tuple(r) for r in history_dedup.deduplicate_batches(df, "batch_no", "ex_id", "source", index).collect()}
    assert got == greedy([(i, t) for i, _, t, _ in rows])


def test_history_dedup_in_blocks_by_shuffle_with_new_centres(spark, monkeypatch):
    monkeypatch.setattr(history_dedup, "BLOCK", 8)
    monkeypatch.setattr(history_dedup, "PART", 20)
    monkeypatch.setattr(history_dedup, "FEW", 0)
    monkeypatch.setattr(history_dedup, "SETTLED_AT_ONCE", 0)
    monkeypatch.setattr(history_dedup, "REFIT", 2)
    monkeypatch.setattr(history_dedup, "SAMPLE", 16)
    rows = dealt(random.Random(14))
    df = spark.createDataFrame(rows, "ex_id long, batch_no int, source string, vec int")
    index = history_dedup.HistoryIndex(spark, cell_rows=2, cells_per_file=4)
    got = {tuple(r) for r in history_dedup.deduplicate_batches(df, "batch_no", "ex_id", "source", index).collect()}
    assert len(index.trees) > 1 and got == greedy([(i, t) for i, _, t, _ in rows])


def test_history_dedup_reopened_index(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS[:25]) for _ in range(24)) for _ in range(30)]
    texts += [shaken(rng, t, 0.08) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "ex_id long, source string")
    first = history_dedup.HistoryIndex(spark)
    a = {tuple(r) for r in first.ingest(df.where("ex_id < 35"), "ex_id", "source").collect()}
    again = history_dedup.HistoryIndex(spark, first.path)
    b = {tuple(r) for r in again.ingest(df.where("ex_id >= 35"), "ex_id", "source").collect()}
    assert a | b == greedy(list(enumerate(texts)))


def test_history_dedup_reads_a_falling_share_of_history(spark):
    """A last batch of ten rows, half of them copies, against 200 and 1,600 rows accepted before."""
    rng = random.Random(15)
    read = []
    for n in (200, 1600):
        texts = [f"t{k % 40} " * 3 + " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(30)) for k in range(n)]
        index = history_dedup.HistoryIndex(spark, cell_rows=4, cells_per_file=4)
        index.ingest(spark.createDataFrame(list(enumerate(texts)), "ex_id long, source string"), "ex_id", "source")
        last = [(n + k, texts[k * 31 % n] if k % 2 else f"new {k} " * 9) for k in range(10)]
        got = {tuple(r) for r in index.ingest(spark.createDataFrame(last, "ex_id long, source string"), "ex_id", "source").collect()}
        assert got == {(k * 31 % n, n + k) for k in range(1, 10, 2)}
        read.append(spark.read.parquet(*index.files_read).count() / n)
    assert read[1] < read[0] / 3


def test_history_dedup_bounds_never_exclude_a_match():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400 if k % 3 else 10**9, size=rng.integers(1, 90))) for k in range(300)]
    sets += [np.unique(np.append(rng.permutation(v)[len(v) // 9 :], rng.integers(0, 10**9, size=len(v) // 20))) for v in sets]
    tree = history_dedup.CentreTree.fit(history_dedup.sketches(sets))
    leaf, grp, ring = tree.place(history_dedup.sketches(sets))
    flat, starts = history_dedup._flat(sets)
    box = [np.packbits(np.bincount(v & ((1 << history_dedup.BOX) - 1), minlength=1 << history_dedup.BOX) > 0).tobytes() for v in sets]
    n = np.array([len(v) for v in sets])
    cells = pd.DataFrame({"cell": np.arange(len(sets)), "gen": 0, "grp": grp, "n_lo": n, "n_hi": n, "ring_lo": ring, "ring_hi": ring, "box": box})
    i, j = history_dedup._open_cells(flat, starts, n, cells, {0: tree})
    open_pairs = set(zip(i.tolist(), j.tolist()))
    near = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if len(np.intersect1d(sets[a], sets[b])) * 8 >= 7 * max(n[a], n[b])}
    assert near <= open_pairs and len(near) > 400 and len(open_pairs) < 3 * len(near)
    again = history_dedup.CentreTree.unpack(tree.pack())
    assert (again.place(history_dedup.sketches(sets))[1] == grp).all()


@pytest.mark.parametrize("at_once", [0, 10])
def test_history_dedup_names_the_smallest_accepted_row(spark, monkeypatch, at_once):
    monkeypatch.setattr(history_dedup, "SETTLED_AT_ONCE", at_once)
    index = history_dedup.HistoryIndex(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 6), (5, 6)], "id_a long, id_b long")
    with Scratch(spark) as scratch:
        assert {tuple(r) for r in index._settle(edges, scratch).collect()} == {(1, 2), (3, 6)}


@pytest.mark.parametrize("light", [1, 400])
def test_history_dedup_in_one_pass_equals_greedy(spark, monkeypatch, light):
    """Batches in the order of their ids: jobs do not grow with the number of batches."""
    monkeypatch.setattr(history_dedup, "LIGHT", light)
    monkeypatch.setattr(history_dedup, "LONG", 20)
    rows = [(i, i // 24, t) for i, _, t, _ in dealt(random.Random(21))]
    df = spark.createDataFrame(rows, "ex_id long, batch_no int, source string")
    want = greedy([(i, t) for i, _, t in rows])
    assert {tuple(r) for r in history_dedup.deduplicate_in_order(df, "ex_id", "source", first=10, growth=3).collect()} == want
    sc, jobs = spark.sparkContext, []
    for per in (1, 5):
        sc.setJobGroup(group := f"one-pass-{light}-{per}", group)
        got = history_dedup.deduplicate_batches(df.withColumn("batch_no", F.floor(F.col("batch_no") / per)), "batch_no", "ex_id", "source")
        assert {tuple(r) for r in got.collect()} == want
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    sc.setJobGroup("", "")
    assert jobs[0] < jobs[1] + 10


def test_history_dedup_batches_out_of_order(spark):
    rng = random.Random(22)
    base = [sentence(rng, 16) for _ in range(6)]
    rows = [(i, (i * 7) % 3, shaken(rng, base[i % 6], 0.07)) for i in range(40)]
    df = spark.createDataFrame(rows, "ex_id long, batch_no int, source string")
    got = {r[1] for r in history_dedup.deduplicate_batches(df, "batch_no", "ex_id", "source").collect()}
    assert got == {b for _, b in greedy([(i, t) for i, _, t in sorted(rows, key=lambda r: (r[1], r[0]))])}


def test_signatures_never_miss_a_match():
    rng = np.random.default_rng(23)
    sets = [np.unique(rng.integers(0, 60 if k % 3 else 10**9, size=rng.integers(1, 120))) for k in range(300)]
    sets += [np.unique(np.append(rng.permutation(v)[len(v) // 9 :], rng.integers(0, 10**9, size=len(v) // 20))) for v in sets]
    flat, starts = history_dedup._flat(sets)
    n = np.array([len(v) for v in sets])
    order = history_dedup.RareFirst(*np.unique(flat, return_counts=True), 1, len(sets))
    near = {(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) * 8 >= 7 * max(n[a], n[b]) and not np.array_equal(sets[a], sets[b])}
    assert len(near) > 200
    odd = history_dedup._parities(flat, starts)
    for order.light, order.long in ((2, 40), (20, 512), (400, 512)):
        who, key = order.signatures(flat, starts)
        own = [set(key[who == i].tolist()) for i in range(len(sets))]
        assert all(own[a] & own[b] for a, b in near)
    for a, b in near:
        apart = n[a] + n[b] - 2 * len(np.intersect1d(sets[a], sets[b]))
        assert sum((int(x) & (1 << 64) - 1).bit_count() for x in odd[a] ^ odd[b]) <= apart


def test_history_dedup_empty(spark):
    df = spark.createDataFrame([], "ex_id long, batch_no int, source string")
    assert history_dedup.deduplicate_batches(df, "batch_no", "ex_id", "source").count() == 0
    none = spark.createDataFrame([(1, 0, None), (2, 0, "")], "ex_id long, batch_no int, source string")
    assert history_dedup.deduplicate_batches(none, "batch_no", "ex_id", "source").count() == 0


# ---- 2

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        d = plain_distance(a, b)
        assert split_overlap.edit_distance(a, b, 20) == d and (split_overlap.edit_distance(a, b, 3) <= 3) == (d <= 3)


@pytest.mark.parametrize("letters", [8_000_000, 90])
def test_overlaps_equal_brute_force(spark, monkeypatch, letters):
    """Also in shards of 90 letters, more than 20 of them."""
    monkeypatch.setattr(split_overlap, "SHARD_LETTERS", letters)
    monkeypatch.setattr(split_overlap, "TASK_LETTERS", 50 * letters)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde 1") for _ in range(rng.choice([1, 3, 7, 8, 9, 24, 60, 150]))) for _ in range(30)]

    def noisy(t):
        t = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 7))):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "y"])
        return rng.choice(["", "​", "É"[:0]]) + "".join(t).upper()

    rows = [(i, rng.choice(["train", "test", "validation", None]), rng.choice([None, "", "?!", *[noisy(rng.choice(base)) for _ in range(9)]]), "x") for i in range(160)]
    df = spark.createDataFrame(rows, "row_id long, split string, source string, t string")
    ev, tr = F.coalesce(F.col("split").isin("test", "validation"), F.lit(False)), F.coalesce(F.col("split") == "train", F.lit(False))
    got = {tuple(r) for r in split_overlap.overlap_pairs(*split_overlap.overlaps(df, "row_id", "split", "source", tr, ev)).collect()}
    want = set()
    for (i, s, a, _), (j, z, b, _) in itertools.product(rows, rows):
        if s == "train" and z in ("test", "validation"):
            x, y = fold_letters(a), fold_letters(b)
            if x and y and plain_distance(x, y) <= max(len(x), len(y)) // 8:
                want.add((min(i, j), max(i, j)))
    assert got == want and want


def test_overlaps_with_long_training_text(spark):
    rng = random.Random(17)
    short = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (40, 90, 300)]
    long = "".join(rng.choice("abcdefgh") for _ in range(40_000)) + "".join(short)
    shard = split_overlap.PassageShard([1, 2, 3], short)
    assert [m[:2] for m in shard.scan([short[0], long, short[2][1:], long[-2000:]])] == [(1, 0), (3, 2)]
    assert shard.scan([short[0]])[0][2] == [k * 40 // 6 for k in range(6)] and split_overlap.passage_size(40) == 6
    assert split_overlap.shard_edges({5: 10, 6: 12, 9: 200}, 30) == [(5, 6, 1), (9, 9, 7)]
    df = spark.createDataFrame([*((k, "test", t) for k, t in enumerate(short)), (10, "train", long), (11, "train", short[1] + "x"), (12, "train", long[5:])], "row_id long, split string, source string")
    found = split_overlap.overlaps(df, "row_id", "split", "source", F.col("split") == "train", F.col("split") == "test")
    assert [tuple(r) for r in split_overlap.overlap_pairs(*found).collect()] == [(1, 11)]


def test_overlaps_of_texts_from_few_patterns(monkeypatch):
    """Passages shared by chance must not cost work pair by pair: all matches are found, few pairs are looked at singly."""
    rng = random.Random(23)
    words = [["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(12)] for _ in range(4)]

    def text():
        return "".join("".join(rng.choice(w) for w in words) + str(rng.randint(0, 99)) for _ in range(12))

    def noisy(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + rng.choice([0, 1])] = rng.choice(["", "x", "7"])
        return "".join(t)

    ev = list(dict.fromkeys(text() for _ in range(1500)))
    tr = [*(noisy(t, len(t) // rng.choice([8, 9, 40])) for t in ev[::50]), *(text() for _ in range(70))]
    seen = []
    decided = split_overlap.PassageShard._decided
    monkeypatch.setattr(split_overlap.PassageShard, "_decided", lambda self, name, t, who: seen.extend(who) or decided(self, name, t, who))
    got = [m[:2] for m in split_overlap.PassageShard(list(range(len(ev))), ev).scan(tr)]
    assert sorted(got) == [(i, k) for i, a in enumerate(ev) for k, b in enumerate(tr) if split_overlap.same(a, b)] and len(got) > 20
    assert len(seen) < len(ev) * len(tr) // 1000


def test_passages_added_up():
    rng = np.random.default_rng(3)
    for rows in (1, 2, 3, 9, 70, 131):
        bits = rng.integers(0, 2, (rows, 128), dtype=np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        total = sum(np.unpackbits(d.view(np.uint8), bitorder="little").astype(int) << i for i, d in enumerate(split_overlap.add_up(packed.copy())))
        assert total.tolist() == bits.sum(axis=0).tolist()
        for most in (1, rows, rows + 1, 300):
            assert np.unpackbits(split_overlap._enough(packed, np.arange(rows), most).view(np.uint8), bitorder="little").tolist() == (bits.sum(axis=0) >= most).tolist()
    assert all(n // split_overlap.PROBE > n * 8 // 7 // 8 for n in range(2 * split_overlap.PROBE, 5000))  # some passage is always left


def test_overlaps_empty(spark):
    df = spark.createDataFrame([], "row_id long, split string, source string")
    links, ev, tr = split_overlap.overlaps(df, "row_id", "split", "source", F.col("split") == "train", F.col("split") == "test")
    assert split_overlap.overlap_pairs(links, ev, tr).count() == 0
    assert split_overlap.overlap_report(df.withColumn("corpus", F.lit("c")), links, ev, tr, "row_id", "split", "corpus").count() == 0


# ---- 3

def test_record_keys():
    k = grouped_split.record_keys
    assert k("[Hnd-01075] x") == ["case:HND1075"] and k("ref hnd_1075\n— Kulu.Vipo") == ["author:kulu.vipo", "case:HND1075"]
    assert k("See SLA-1180, RFC 2119 and channd-12") == [] and k(None) == [] and k("cc: <help.desk@desk.example>") == []
    assert k("From: <a.b@desk.example>") == k("@A.B wrote:") == k("text [A.B]") == ["author:a.b"]
    assert k("Ｈ​ＮＤ–１２") == ["case:HND12"] and k("Author: x.y\ncc: <c.d@e.f>") == ["author:x.y"]


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        text = rng.choice([None, "", f"CMP-{rng.randint(1, 60)} text", f"Author: {rng.choice('abcdefgh')}{rng.choice('abcdefgh')}.x\nsee HND#{rng.randint(1, 40)}", "plain"])
        rows.append((i, rng.choice([None, " ", f"id{rng.randint(0, 200)}:{rng.randint(0, 3)}", "hot"] if i % 3 else ["hot:1"]), text, "clash"))
    df = spark.createDataFrame(rows, "row_id long, id string, source string, component string")
    got = {r["id"]: r["group_id"] for r in grouped_split.components(df, "row_id", "id", "source").collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, a, t, _ in rows:
        keys = grouped_split.record_keys(t) + ([a.strip().split(":")[0]] if a and a.strip() else [])
        for k in keys:
            up[find(k)] = find(i)
        find(i)
    least = {}
    for i, *_ in rows:
        least[find(i)] = min(least.get(find(i), i), i)
    assert got == {i: least[find(i)] for i, *_ in rows}


def test_keys_of_one_record_make_no_edges(spark, monkeypatch):
    edges, found = [], grouped_split.hash_to_min

    def counted(e, a, b):
        edges.append(e.count())
        return found(e, a, b)

    monkeypatch.setattr(grouped_split, "hash_to_min", counted)
    rows = [(i, f"id{i}", f"CMP-{i} of HND-{i % 20 + 1}\nAuthor: a{i}.x") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, id string, source string")
    got = {r["id"]: r["group_id"] for r in grouped_split.components(df, "row_id", "id", "source").collect()}
    assert got == {i: i % 20 for i in range(100)} and edges == [0]


def test_hot_join_equals_join(spark):
    left = spark.range(200).select((F.col("id") % 20 * (F.col("id") % 2)).alias("k"), "id")
    right = left.groupBy("k").agg(F.max("id").alias("m")).where("k <> 3")
    sizes = left.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        assert sorted(hot_join(left, right, "k", F.col("id"), sizes, how, 4, 50).collect()) == sorted(left.join(right, "k", how).collect())


def test_splits_hold_weights_and_groups(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 5000).alias("group_id"))
    out = grouped_split.assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1})
    n = {r[0]: r[1] for r in out.groupBy("new_split").count().collect()}
    assert abs(n["train"] / 20_000 - 0.8) < 0.03 and abs(n["test"] / 20_000 - 0.1) < 0.02
    assert out.groupBy("group_id").agg(F.count_distinct("new_split").alias("k")).where("k > 1").count() == 0


def test_components_empty(spark):
    df = spark.createDataFrame([], "row_id long, id string, source string")
    assert grouped_split.components(df, "row_id", "id", "source").count() == 0


# ---- 4

SRC = "The queue drops old rows at night. Never touch src/a_b.py without a warning. Why does Kovi report 12 failures when the cache is full? Done: the scorer now keeps the base image."


CASES = [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("​", "empty"), ("...", "empty"), ("[]", "empty"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Desculpe, mas não posso ajudar com esse pedido.", "refusal"), ('You wrote: "The queue drops old rows at night." Sorry, this is something I won\'t do.', "refusal"),
        ("Lo siento, no puedo ayudar con esa solicitud.", "refusal"), ("申し訳ありませんが、お手伝いできません。", "refusal"), (SRC, "copied"), (SRC.upper(), "copied"),
        ("Die Warteschlange verwirft alte Zeilen in der Nacht und der Bewerter behält das Bild.", "wrong_language"), ("Никогда не меняйте файл без предупреждения.", "wrong_language"),
        ("The queue drops old rows at night. Never touch src/a_b.py wit", "truncated"), ("The queue drops old rows at night. Never touch…", "truncated"), ("- The queue drops old rows at night\n- Never touch src/a_b", "truncated"),
        ("The queue drops old rows at night. Never touch src/a_b.py without a warning", None), ("Never touch src/a_b.py without a warning.", None), ("- The queue drops old rows at night\n- Never touch src/a_b.py without a warning", None),
        ("the queue drops\nold rows at night.", None),
        ("Never touch src/a_b.py without a warning. Why does Kovi report `", "truncated"), ("Never touch src/a_b.py without a warning. Why does Kovi —", "truncated"),
]


def test_defects(spark):
    rows = [(k, SRC, t) for k, (t, _) in enumerate(CASES)]
    # the shortened sentence is no sentence of this row's own source
    rows.append((999, "Something else is here. And it goes on.", "The queue drops old"))
    df = spark.createDataFrame(rows, "ex_id long, source string, target string").repartition(3)
    got = {r[0]: r[1] for r in pair_defects.pair_defects(df, "ex_id", "source", "target").collect()}
    assert got == {k: d for k, (_, d) in enumerate(CASES) if d}


def test_letter_models_tell_unlisted_languages(spark):
    rng = random.Random(25)
    said = ["the worker keeps its cache", "all rows were copied to the disk", "nobody has changed this file", "the tests passed again", "we must restart the server before noon", "it writes a short report for the team"]
    sources = [". ".join(rng.sample(said, 4)) + f" {rng.random()}." for _ in range(60)]
    models = pair_defects.letter_models(spark.createDataFrame([(t,) for t in sources], "s string"), "s")
    assert list(models) == ["en"]
    for target, want in (("Kolejka zapisuje ponownie wszystkie wiersze przed restartem", "wrong_language"), ("Sunucu bütün satırları yeniden kopyaladı", "wrong_language"), ("a report for the team was copied by the worker", None)):
        assert pair_defects.defect(sources[0], target, models) == want


def test_letter_models_count_every_source(spark):
    """A language of 31 in 4,031 sources has a model, and the models are those of all texts."""
    rng = random.Random(26)
    en = ["the worker keeps its cache", "all rows were copied to the disk", "the tests have passed again", "we must restart the server before noon"]
    de = ["der server kopiert die zeilen und wartet nicht", "wir haben das nicht geprüft und die datei ist alt", "die tests sind nicht mehr rot"]
    sources = [". ".join(rng.sample(en, 3)) + f" {k}" for k in range(4000)] + [". ".join(rng.sample(de, 2)) + f" {k}" for k in range(31)]
    models = pair_defects.letter_models(spark.createDataFrame([(t,) for t in [*sources, None, " "]], "s string"), "s")
    assert sorted(models) == ["de", "en"]
    for lang, texts in (("en", sources[:4000]), ("de", sources[4000:])):
        words = [pair_defects.prose_words(pair_defects.fold(t)) for t in texts]
        lines = [f" {' '.join(w)} " for w in words]
        assert models[lang].three == Counter(t[i : i + 3] for t in lines for i in range(len(t) - 2))
        assert models[lang].two == Counter(t[i : i + 2] for t in lines for i in range(len(t) - 2))
        assert abs(models[lang].usual - sum(models[lang].rate(w) for w in words) / len(words)) < 1e-5


def test_defect_frame(spark):
    rows = [(1, SRC, None, 1), (1, SRC, None, 1), (2, None, None, 1), (3, " ", "x", 1), (4, "x " * 50_000, "y", 1)]
    df = spark.createDataFrame(rows, "ex_id long, source string, target string, defect int")
    assert sorted(map(tuple, pair_defects.pair_defects(df, "ex_id", "source", "target").collect())) == [(1, "empty"), (1, "empty")]
    assert pair_defects.pair_defects(df.limit(0), "ex_id", "source", "target").count() == 0


def test_shortened_and_spikes(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "Alpha  beta ..."), (4, "zeta"), (5, None), (6, "alpha betas")], "id long, t string")
    got = {(r["id"]) for r in pair_defects.shortened_responses(df, "id", "t").collect()}
    assert got == {2, 3}
    rng = random.Random(15)
    many = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(many)), "id long, t string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"] for r in pair_defects.shortened_responses(frame.repartition(3), "id", "t").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {i for i, t in enumerate(many) if any(u != t and u.startswith(t) for u in many)}
    cut = spark.createDataFrame([("x " * 19 + "xx",)] * 30 + [("y " * (k // 2) + "y" * (k % 2),) for k in range(30, 50)], "t string")
    assert [r["n_chars"] for r in pair_defects.length_spikes(cut, "t").collect()] == [40]


# ---- 5

def test_longest_match_equals_greedy():
    rng = random.Random(9)
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 5))) for _ in range(12)})
        m = token_budget.LongestMatch(pieces)
        known = set(pieces)

        def greedy_count(t):
            n = i = 0
            while i < len(t):
                k = next((k for k in range(min(6, len(t) - i), 0, -1) if t[i : i + k] in known), 0)
                n += 1 if k else len(t[i].encode())
                i += k or 1
            return n

        for _ in range(40):
            t = "".join(rng.choice("abcdé▁") for _ in range(rng.randint(0, 25)))
            assert m.run(t) == greedy_count(t)


def test_word_memo_changes_nothing():
    m = token_budget.LongestMatch(["▁the", "▁", "t", "h", "e", "▁▁", "he"])
    for t in ("the the he", " the  the", "the\nthe  ", "日本 the", "", "   ", None):
        assert m.count(t) == (m.run("▁" + t.replace(" ", "▁")) if t and t.strip() else 0)


def test_budget(spark):
    rows = [(1, "a b", "en-US", 3), (2, "a b", "EN", 1), (3, None, "und", 1), (4, " ", None, 1), (5, "c", "pt_BR", None)]
    df = spark.createDataFrame(rows, "row_id long, source string, language string, at long").withColumn("loaded_at", F.timestamp_seconds("at"))
    counter = token_budget.longest_match_counter(spark, ["▁a", "▁b", "▁", "c"])
    out = token_budget.budget(token_budget.token_counts(df, counter, "row_id", "source", "loaded_at", {"language": token_budget.clean_language(F.col("language"))}), ["language"])
    got = {r["language"]: (r["n_records"], r["n_usable"], r["tokens_total"], r["tokens_usable"]) for r in out.collect()}
    assert got == {"en": (2, 1, 4, 2), "unknown": (2, 0, 0, 0), "pt": (1, 1, 2, 2)}


def test_calibration_covers_every_text(spark):
    import os

    import sentencepiece

    from quillspark.llm import queries

    path = os.path.join(queries.TOKENIZERS, "piece_bpe_32k.model")
    rng = random.Random(16)
    rows = [("one text again and again", "hot")] * 1500 + [(sentence(rng, 6), rng.choice(["a", "b"])) for _ in range(900)] + [("A lone text.", "rare"), (None, "a"), (" ", "a"), ("\n\t", "blank"), ("\u200b", "none")]
    df = spark.createDataFrame(rows, "t string, lang string")
    got = {r["slice"]: (r["n"], r["estimated"], r["exact"]) for r in token_budget.calibration(df, "t", F.col("lang"), path).collect()}
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), token_budget.LongestMatch(token_budget.piece_vocabulary(path))
    want = {}
    for t, lang in rows:
        if t and t.strip():
            n, e, x = want.get(lang, (0, 0, 0))
            want[lang] = n + 1, e + m.count(t), x + len(sp.encode(t))
    assert got == want and sum(n for n, *_ in got.values()) == 2402


# ---- 6

def test_best_pattern_equals_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        room = rng.randint(1, 25)
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 26), rng.randint(1, 5))}
        p = bin_slack.best_pattern(counts, room)
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for s in map(sum, itertools.combinations(items, k)) if s <= room) if len(items) <= 11 else None
        total = sum(n * k for n, k in p.items())
        assert total <= room and all(k <= counts[n] for n, k in p.items()) and (best is None or total == best)


def test_pack(spark):
    rng = random.Random(11)
    items = [(i, rng.choice([0, 1, 3, 7, 10, 16, 16, 16, 33, 100])) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(items, "id long, tokens int")
    w = spark.createDataFrame([("s", 16), ("l", 50), ("none", 0)], "window_name string, capacity_tokens int")
    out = bin_slack.pack(df, w).collect()
    for name, cap in (("s", 16), ("l", 50)):
        mine = [r for r in out if r["window_name"] == name]
        fill, got = Counter(), {}
        for r in mine:
            fill[r["bin"]] += r["tokens"]
            got.setdefault(r["id"], []).append((r["piece_no"], r["start_token"], r["tokens"]))
        assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
        assert {i: sum(t for *_, t in p) for i, p in got.items()} == {i: t for i, t in items if t}
        assert all(len(p) == 1 or sum(t for *_, t in p) > cap for p in got.values())
        assert len(fill) <= 1.05 * -(-sum(t or 0 for _, t in items) // cap) + 2
    assert bin_slack.pack(df.limit(0), w).count() == 0


def test_spread_rank_is_a_rank(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"))
    for r in spread_rank(df, "g", ["id"], "id", slices=8).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect():
        assert r["r"] == list(range(len(r["r"])))


# ---- 7

def test_mix(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None, "other"]), rng.choice([None, "", "dup text", f"text {i} " + "x " * rng.randint(1, 60)])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "id long, source string, text string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 1), ("c", 0.1, 2), ("missing", 0.0, 2)], "source string, weight double, max_repeats int")
    items = source_mix.usable(docs, targets, lambda c: F.size(F.split(c, " ")), "id", "text", "source")
    assert items.count() == items.select("id").distinct().count()
    chosen, report = source_mix.mix(items, targets)
    cap = {"a": 3, "b": 1, "c": 2}
    assert all(0 < r["copies"] <= cap[r["source"]] for r in chosen.collect())
    for r in report.collect():
        assert abs(r["share_error"]) < 0.02, r
    empty = source_mix.mix(items.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_very_long_text_is_sized_whole():
    class Enc:
        def encode_ordinary(self, t):
            return t.split()

    t = "word " * 100_000
    assert token_sizes.size(Enc(), t) == 100_000 and token_sizes.size(Enc(), None) == 0 and token_sizes.size(Enc(), " ") == 0


# ---- 8

TERMS = [("idiot", "abusive"), ("vermin", "hateful"), ("naked", "sexual"), ("kill", "abusive")]
HITS = [
    ("Shut up, 1d107.", "abusive"), ("GO TO HELL, YOU JAC*ASS...", "abusive"), ("do everyone a favour and d i s a p p e a r for good", "abusive"), ("you are such a uselеss mооron", "abusive"),
    ("Vai pro inferno, seu idio*a", "abusive"), ("eres un payaso de mierda", "abusive"), ("va au diable, crétin!", "abusive"), ("HALT DIE KLAPPE, DU VOLLPFOSTTTTEN", "abusive"), ("Those Tundrils are ver​min.", "hateful"),
    ("I hate Qorim, they breed like rats", "hateful"), ("Os Ruvenes não merecem viver entre nós", "hateful"), ("Diese Kaltish sind Ungeziefer", "hateful"), ("she was n a k e d and moaning in his bed", "sexual"), ("Quiero lamer tus muslos toda la noche", "sexual"),
    ("send me nude pics of your thig*s", "sexual"),
]
CLEAN = [
    "The stupid cache bug is back, what a pathetic retry loop.", "Kill the orphan child process before the parent dies.", "The naked pointer is stripped from the hot path.", "The primary master rejects the slave replica.",
    "The abuse filter must reject insults, slurs and sexual content.", "Migrants can apply with form 41 today.", "Breast cancer screening rows need the same mask as other health data.", "Esse cache idiota voltou a falhar.",
    "Qué caché tan estúpida, falla otra vez.", "Le champ sexe est facultatif dans le formulaire.", "Dieser dumme Cache fällt schon wieder aus.", "We need idiot-proof defaults for new projects.", "Attack surface: one exposed port, two dead hosts.", "The glossary lists the insult shut up as an example.", "",
]


def test_scores():
    s = content_scores.Scorer(TERMS)
    for t, c in HITS:
        found = s.score("Set a=1. " + t + " Check b.")
        assert found.get(c, (0, 0))[0] >= content_scores.THRESHOLD, (t, found)
    for t in CLEAN:
        assert all(v < content_scores.THRESHOLD for v, _ in s.score(t).values()), (t, s.score(t))


def test_long_stretches_are_found():
    s = content_scores.Scorer(TERMS)
    for n in (3, 20, 30, 5000):
        for token in ("idi" + "o" * n + "t", "1d1" + "0" * n + "t", "idi" + "o0" * n + "t", "idi" + "*" * n + "ot", "i" * n + "d" * n + "iot", "ver" + "m" * n + "in"):
            assert s.lookup(token) is not None, token[:40]
        assert s.score("You are such an idi" + "o" * n + "t.").get("abusive") == s.score("You are such an idiooot.").get("abusive")
        assert s.score("GO TO HELL, YOU JACK" + "A" * n + "SS").get("abusive", (0, 0))[0] >= content_scores.THRESHOLD
    assert s.lookup("abcdefgh" * 40) is None and s.lookup("qWxyz012" * 500) is None


def test_levenshtein_equals_brute_force():
    rng = random.Random(13)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(60)}
    trie = content_scores.Trie(words)
    for _ in range(100):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))
        near = {w for w, _ in trie.within(t, 2)}
        assert {w for w in words if plain_distance(w, t) <= 2} <= near
        assert all(plain_distance(w, t) <= 4 for w in near)


def test_parts_lose_no_near_word():
    rng = random.Random(14)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 13))) for _ in range(80)}
    trie, parts = content_scores.Trie(words), content_scores.Parts(words)
    for _ in range(400):
        t = list(rng.choice(sorted(words)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.choice([0, 1, 2])] = rng.choice([[], ["a"], ["d", "b"], t[k : k + 2][::-1]])
        t = "".join(t)
        if len(t) >= 5:
            most = 2 if len(t) >= 10 else 1
            if trie.within(t, most):
                assert parts.two(t) if most == 2 else parts.one(t)


def test_score_frames(spark):
    rows = [(1, "s", HITS[0][0], 1), (1, "s", HITS[0][0], 1), (2, None, None, 1), (3, "", " ", 1), (4, "s", "line " * 60_000 + HITS[8][0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, score int")
    terms = spark.createDataFrame([*TERMS, (None, None)], "term string, category string")
    sc = content_scores.content_scores(df, terms, "doc_id", "text")
    assert {(r["id"], r["category"]) for r in sc.where("score >= 0.5").collect()} == {(1, "abusive"), (4, "hateful")}
    rates = {r["source"]: (r["n_docs"], r["n_abusive"], r["n_hateful"]) for r in content_scores.source_rates(df, sc, "doc_id", "source").collect()}
    assert rates == {"s": (3, 2, 1), "unknown": (2, 0, 0)}
    assert content_scores.content_scores(df.limit(0), terms, "doc_id", "text").count() == 0


def test_all_queries_run(spark, sf):
    from quillspark.llm import queries

    for name, q in queries.queries().items():
        assert q(spark, sf).count() >= 0, name
