"""Operators over DataFrames: ledger text, policy, near-duplicates, datasets, evaluation, scorers, sources, streams."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import code, pairs, udfs
from quillspark.operators import compaction, datasets, evaluate, ledger, neardup, policy, scorer
from quillspark.operators.spread import salted_join
from quillspark.sources import io
from quillspark.streaming import flows

LEDGER = "ts double, source string, cwd string, model string, session string, in_chars long, out_chars long, units int, kept int, ms double"


@pytest.fixture()
def book(spark):
    rows = [(0.0, "cli", "/a", "m", "s1", 1000, 200, 4, 2, 1.0), (86400.0, None, "/a/b", "m", "s2", 500, 500, None, None, None), (None, "", "", None, None, None, None, None, None, 3.0)]
    return spark.createDataFrame(rows, LEDGER)


def test_ledger(book, spark):
    s = ledger.summary(book).first()
    assert (s["requests"], s["input_tokens"], s["output_tokens"], s["saved_tokens"], s["saved_pct"], s["avg_ms"]) == (3, 375, 175, 200, 53.3, 1.3)
    assert {r["name"]: r["requests"] for r in ledger.by_key(book, "source").collect()} == {"cli": 1, "unknown": 2}
    assert ledger.in_project(book, "/a/b").count() == 2 and ledger.in_project(book, "/a").count() == 1 and ledger.in_project(book, "/ab").count() == 0
    assert ledger.in_session(book, "s1").count() == 1 and ledger.since_days(book, 100000.0, 1).count() == 1
    assert ledger.one_line(book, "1970-01-01").first()[0] == "200 saved · 53.3% · 3 reqs · today 200" and ledger.one_line(book, session="s1").first()[0] == "200 saved · 80.0%"
    assert ledger.one_line(book.limit(0), "1970-01-01").first()[0] == "no data" and ledger.summary(book.limit(0)).first()["avg_ms"] == 0.0
    text = ledger.render(book, spark_days=True)
    assert "Requests:        3" in text and "By Project" in text and "Last 2d:" in text
    got = [r[0] for r in spark.createDataFrame([(999,), (1234,), (5_600_000,), (7_000_000_000,), (10**16,)], "v long").select(ledger.human(F.col("v"))).collect()]
    assert got == ["999", "1.2K", "5.6M", "7.0B", "10.0P"]


def test_policy(spark):
    p = policy.Policy(min_chars=5, keep_recent=1, budget_ratio=0.5)
    rows = [(1, 0, "user", "long enough text", 0), (1, 1, "tool", "error: long text", 1), (1, 2, "user", "recent one here", 2), (2, 0, "SYSTEM", "system text here", 0), (2, 1, "user", "x", 1)]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, received_at int")
    got = {(r["conv_id"], r["turn"]): r["eligible"] for r in policy.eligible_turns(t, "conv_id", "turn", "role", "text", 10, p).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): False, (2, 0): False, (2, 1): False}
    off = policy.eligible_turns(t, "conv_id", "turn", "role", "text", 10, policy.Policy(mode="off"))
    assert off.where("eligible").count() == 0
    parts = spark.createDataFrame([("text", None), ("tool-result", "text"), ("tool-result", "error"), ("tool-result", "content"), ("media", None)], "k string, r string")
    assert [r[0] for r in parts.select(policy.part_route(F.col("k"), F.col("r"))).collect()] == ["text", "value", "none", "content", "none"]
    twice = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None)], "id int, t string")
    out = policy.once_per_payload(twice, "t", "o", lambda d: d.withColumn("o", F.upper("payload"))).orderBy("id").collect()
    assert [r["o"] for r in out] == ["AA", "AA", None]


CHECKPOINT = "Great question, happy to look.\nDecision: keep the cache.\nNext: run the tests in src/a_b.py.\nThe sky is blue and nice today.\nOnly maintainers can deploy."


def test_checkpoint_and_compaction(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n c1\n c2\n c3\n-a\n+b"
    df = spark.createDataFrame([(1, CHECKPOINT, 5), (2, "short", 5), (3, None, 5), (4, diff, 5)], "id int, text string, units int").drop("units")
    got = {r["id"]: r for r in compaction.checkpoint(df, "text").collect()}
    out = got[1]["text_out"]
    assert "Decision: keep the cache." in out and "Next: run the tests" in out and "Only maintainers" in out and "sky" not in out and "Great" not in out
    assert got[2]["text_out"] == "short" and got[3]["text_out"] is None and " c1" not in got[4]["text_out"] and got[1]["ratio"] < 1
    long = " ".join(f"Filler sentence {chr(97 + k)} about nothing at all." for k in range(26)) + " You must never delete src/x.py."
    kept = compaction.compact(spark.createDataFrame([(1, long)], "id int, text string"), "text", lambda t: [0.0] * len(t), 0.5).first()
    assert "never delete src/x.py" in kept["text_out"] and kept["kept"] < kept["units"]


def test_native_clauses_equal_kernel(spark):
    from quillspark.functions import spans

    texts = ["a, b. c; d 3.12 x", "日本。語！ عربي، نص؟ end", "  lead\n\n trail  \nno stop", "!!!", "", "x" * 5000 + ". y", "a.b.c , d"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in compaction.clause_rows(df, "id", "t").orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["clause"], r["start_off"], r["end_off"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(t[a:b], a, b) for a, b in spans.clauses(t)]


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(12)]
    texts = base + [b + " tail" for b in base] + base[:3] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    h = neardup.banded(df, "id", "t")
    hs = sorted((r["id"], r["h"]) for r in h.collect())
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    want = {(i, j) for i, a in hs for j, b in hs if i < j and near(a, b)}
    got = {tuple(r) for r in neardup.near_pairs(h).collect()}
    assert got == want
    kept: list = []
    for i, a in hs:
        if not any(near(a, b) for _, b in kept):
            kept.append((i, a))
    assert sorted(r[0] for r in neardup.accept_in_order(h).collect()) == [i for i, _ in kept]
    assert neardup.exact_groups(df, "id", "t").where("copies = 2").count() == 3


def test_every_copy_has_its_class(spark):
    rng = random.Random(18)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(5)]
    rows = [(100, texts[0]), (101, texts[0].upper()), *((k, " " + texts[1]) for k in range(30)), (200, texts[2]), (201, texts[2] + " tail"), (202, texts[2] + "  TAIL"), (300, texts[3]), (400, None), (401, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(tuple(r) for r in neardup.with_copies(df, "id", "t").collect())
    pairs_ = sorted(tuple(r) for r in neardup.near_pairs(neardup.banded(df, "id", "t")).collect())
    copies = [(100, 101), *((0, k) for k in range(1, 30)), (201, 202)]
    assert got == sorted(pairs_ + copies) and not set(pairs_) & set(copies)


def test_ngram_overlap_without_broadcast(spark):
    rng = random.Random(7)
    words = lambda k: " ".join(rng.choice("abcdef") * 2 for _ in range(k))
    long = words(300)
    left = [(1, long), (2, long[:200].upper()), (2, long[100:400]), (3, "a b c d e f g"), (4, "a b c d e f g h"), (5, "x " * 40), (6, None), (7, ""), (None, long[:90])]
    right = [(1, long[150:500]), (2, None), (3, "A, b; c d e f g h!"), (4, "x y"), (5, words(200))]
    grams = lambda t: {tuple(w[k : k + 8]) for w in [(t or "").lower().replace(",", "").replace(";", "").replace("!", "").split()] for k in range(len(w) - 7)}
    held = set().union(*(grams(t) for _, t in right))
    want: dict = {}
    for i, t in left:
        want.setdefault(i, set()).update(grams(t))
    want = {i: (len(g), len(g & held), round(len(g & held) / len(g), 4)) for i, g in want.items() if g}
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1b")
    try:
        df = neardup.ngram_overlap(spark.createDataFrame(left, "id long, t string"), spark.createDataFrame(right, "k long, s string"), "id", "t", "s")
        got = {r["id"]: (r["n_grams"], r["n_shared"], r["share"]) for r in df.collect()}
    finally:
        spark.conf.unset(limit)
    assert got == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("split(") == 2


def test_splits_windows_and_checks(spark):
    keys = [f"g{k}:{j}" for k in range(40) for j in range(2)]
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    out = datasets.hash_split(df, datasets.group_key(F.col("id")), 0.34, 7).collect()
    import hashlib

    order = sorted({k.split(":")[0] for k in keys}, key=lambda g: hashlib.sha256(f"7:{g}".encode()).digest())
    want = set(order[: round(40 * 0.34)])
    assert {r["id"].split(":")[0] for r in out if r["is_validation"]} == want
    a, b = datasets.shuffled_split(list(range(10)), 0.2, 3)
    assert len(b) == 2 and sorted(a + b) == list(range(10))
    w = spark.createDataFrame([("r", [("a",), ("b",), ("c",), ("d",), ("e",)], [1, 0, 1, 0, 1]), ("bad", [("a",)], [1, 1])], "id string, units array<struct<text:string>>, labels array<int>")
    got = datasets.windows(w, "id", "units", F.col("labels"), 2).orderBy("window_id").collect()
    assert [r["labels"] for r in got] == [[1, 0], [1, 0], [1]] and [r["window_id"] for r in got] == ["r:0", "r:1", "r:2"]
    steps = spark.createDataFrame([([("a", "x", ["f"], False)], [("keep", ["a"], "x", ["f"])], ["f", "g"])], "u array<struct<id:string,text:string,fact_ids:array<string>,protected:boolean>>, s array<struct<operation:string,source_unit_ids:array<string>,output:string,covered_fact_ids:array<string>>>, r array<string>")
    assert steps.select(datasets.transformation_errors(F.col("u"), F.col("s"), F.col("r"))).first()[0] == ["missing_required_facts:['g']"]


def test_policy_rows_and_wiki(spark):
    ph = spark.createDataFrame([("en", [f"p{k}" for k in range(9)], ["c0", "c1"], "noise"), ("pt", [f"q{k}" for k in range(9)], [], "ruido")], "language string, keep array<string>, commands array<string>, noise string")
    rows = datasets.policy_rows(spark, ph, 0, 10).collect()
    assert len(rows) == 20
    for r in rows:
        i = int(r["id"].split("-")[-1])
        texts = [u["text"] for u in r["units"]]
        assert len(texts) == 9 + 3 + i % 5 + 1 and len(r["target_unit_ids"]) == 9 and r["source"] == "\n".join(texts)
        assert sorted(texts[int(u[1:])] for u in r["target_unit_ids"]) == sorted(r["critical"])
    pages = spark.createDataFrame([("1", 0, "Cat", None, None, [("pt", "Gato")]), ("1", 1, "Cat", "Q1", "x" * 1200, [("es", "Gato"), ("xx", "no")]), ("2", 0, "Dog", None, "short", None)], "pageid string, seq int, title string, item string, extract string, langlinks array<struct<lang:string,title:string>>")
    m = datasets.merged_pages(pages)
    g = datasets.page_groups(m, ["en", "pt", "es"]).collect()
    assert len(g) == 1 and g[0]["group_id"] == "Q1" and g[0]["titles"] == {"en": "Cat", "pt": "Gato", "es": "Gato"}
    al = spark.createDataFrame([("kitty", "Cat"), ("", "Cat"), ("pup", "Dog")], "`from` string, `to` string")
    assert {r["title"] for r in datasets.extracts(m, al).collect()} == {"cat", "kitty"}


def test_evaluation(spark):
    df = spark.createDataFrame([("You must keep src/a_b.py at 5 ms. Extra words here.", "You must keep src/a_b.py at 5 ms.", "You must keep src/a_b.py at 5 ms."), ("Alpha beta.", "beta Alpha.", None)], "s string, o string, t string")
    m = evaluate.measured(df, "s", "o", "t")
    ok = evaluate.gate(m.limit(1), min_ratio=0.1, max_ratio=0.9).first()
    assert ok["passed"] and ok["protected_span_recall"] == 1.0
    assert not evaluate.gate(m).first()["passed"]
    with pytest.raises(ValueError):
        evaluate.gate(m, min_ratio=0.1)
    sweep = evaluate.threshold_sweep(spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.1, 0)], "score double, label int"), "score", "label")
    best = evaluate.chosen_threshold(sweep).first()
    assert best["recall"] == 1.0 and best["retention"] == 0.5 and best["threshold"] == 0.31
    assert evaluate.best_under(sweep).first()["recall"] == 1.0
    v = spark.createDataFrame([(float(k),) for k in range(1, 13)], "ms double")
    assert evaluate.percentile_floor(v, "ms").first()[0] == 12.0
    same = spark.createDataFrame([(1, "alpha beta gamma", "alpha beta gamma"), (2, "alpha beta", "delta eps")], "id int, a string, b string")
    cos = {r["id"]: r["cosine"] for r in evaluate.tfidf_cosine(same, "id", "a", "b").collect()}
    assert abs(cos[1] - 1) < 1e-9 and cos[2] == 0
    g = spark.createDataFrame([("run git now please ok fine yes", "run git", ["git"], ["a>b"], ["a>b"], ["run"]), ("x git", "x", ["git"], [], [], [])], "source string, candidate string, anchors array<string>, required_edges array<string>, candidate_edges array<string>, required_modes array<string>")
    r = evaluate.rewrite_gate(g, F.lit(20), F.lit(10)).collect()
    assert r[0]["use"] and not r[1]["use"]


def test_gate_measures_an_operator(spark, sf):
    from quillspark.plans import queries

    got = {r["language"]: r for r in queries.evaluation_gate(spark, sf).collect()}
    ex = spark.read.parquet(f"{sf}/examples.parquet").where("source is not null and target is not null").select("source", "target", F.lower(F.substring(F.trim("language"), 1, 2)).alias("language"))
    recall: dict = {}
    for r in compaction.checkpoint(ex, "source").collect():
        recall.setdefault(r["language"], []).append(pairs.token_recall(r["target"], r["text_out"]))
    for k, v in recall.items():
        v = [x for x in v if x is not None]
        assert abs(got[k]["valuable_token_recall"] - (sum(v) / len(v) if v else 1.0)) < 1e-9
    assert min(r["valuable_token_recall"] for r in got.values()) < 1.0
    assert all(r["passed"] == (r["protected_span_corruptions"] == 0 and r["extractive_validity"] == 1.0 and r["valuable_token_recall"] >= 0.8) for r in got.values())


def test_recurrent_scorer_step_by_step():
    w = scorer.start_weights(vocab=30, width=4, hidden=3, attention=True)
    units = [[1, 5, 2], [1, 7, 8, 9, 2], [1, 3, 2]]
    x = scorer.pooled(units, w)
    e = w["embedding.weight"]
    assert np.allclose(x[0], (e[1] + e[5] + e[2] + 2 * e[0]) / 5) and np.allclose(x[2], (e[1] + e[2] + 2 * e[0]) / 4)
    h = np.zeros(3)
    p = "document_forward"
    for row, got in zip(x, scorer.gru(x, w, p)):
        a, b = w[f"{p}.Wx"] @ row + w[f"{p}.b"], w[f"{p}.Wh"] @ h
        r, z = scorer.sigmoid(a[:3] + b[:3]), scorer.sigmoid(a[3:6] + b[3:6])
        h = (1 - z) * np.tanh(a[6:] + r * (b[6:] + w[f"{p}.bhn"])) + z * h
        assert np.allclose(h, got)
    assert len(scorer.window_scores(units * 50, w)) == 150
    full = scorer.start_weights()
    assert scorer.parameter_count(full) == 660_737
    q = scorer.quantize(full)
    assert q["keep_head.weight"].dtype == np.int8 and q["embedding.weight"] is full["embedding.weight"]
    rng = random.Random(2)
    data = [([[1, 10 if y else 20, rng.randint(4, 9), 2] for y in ys], ys) for ys in ([rng.randint(0, 1) for _ in range(8)] for _ in range(30))]
    fit = scorer.fit_head(data, scorer.start_weights(vocab=30, width=24, hidden=48), epochs=300)
    right = sum(int((s >= 0.5) == y) for u, ys in data for s, y in zip(scorer.window_scores(u, fit), ys))
    assert right / 240 > 0.9


def test_default_scorer_in_compaction(spark, sf, tmp_path, capsys):
    clauses = [CHECKPOINT, "", "  two  words ", "ÀÉ ǅ straße 12 ٣", "see src/x or a_b, fooBar `x`?", "Okay, LIMITED to é/é", "fatal\u2028error", "undone nextish", "日本 é_é", "FALHOU: não concluído", "Kſ thanks"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(clauses)], "pos int, c string")
    want = {r["pos"]: [float(r[f]) for f in scorer.FEATURES] for r in df.withColumns(scorer.clause_features(F.col("c"), F.col("pos"), F.lit(len(clauses)))).collect()}
    for k, c in enumerate(clauses):
        assert np.allclose(scorer.feature_row(c, k, len(clauses)), want[k]), c
    # labels by what a clause holds: the query's scorer learns them, untrained weights cannot
    rows = [(f"r{k}", [{"text": f"You should ask number {k}?"}, {"text": "the sky is grey and wide"}] * 4, [1, 0] * 4) for k in range(40)]
    labelled = spark.createDataFrame(rows, "id string, units array<struct<text:string>>, labels array<int>")
    score = scorer.default_score(scorer.labelled_clauses(labelled, "id"))
    assert [s >= 0.28 for s in score(["You should ask number 5?", "the sky is grey and wide"] * 3)] == [True, False] * 3
    fitted = scorer.fit_default(scorer.labelled_clauses(labelled, "id"))
    said = fitted.transform(scorer.labelled_clauses(labelled, "id").where("id = 'r7'").orderBy("pos")).collect()
    assert np.allclose(score([r["clause"] for r in said]), [r["probability"][1] for r in said])
    labelled.write.parquet(str(tmp_path / "rows"))
    (tmp_path / "t.txt").write_text(" ".join("the sky is grey and wide." for _ in range(12)))
    from quillspark.__main__ import main

    assert main(["compact", str(tmp_path / "t.txt"), "--rows", str(tmp_path / "rows")]) == 0 and capsys.readouterr().out.count("sky") == 1


def test_sources(spark, tmp_path):
    assert io.ledger_path({"QUILLSPARK_LEDGER": "/x"}) == "/x" and io.ledger_path({"XDG_DATA_HOME": "/d"}) == "/d/quillspark/ledger.jsonl" and io.ledger_path({"HOME": "/h"}).startswith("/h/.local/share")
    p = str(tmp_path / "l.jsonl")
    assert io.read_ledger(spark, p).count() == 0
    with open(p, "w") as f:
        f.write('{"ts": 1.0, "in": 10, "out": 4}\nbroken\n[1]\n{"source": "cli"}\n')
    assert io.read_ledger(spark, p).select("in_chars").collect()[0][0] == 10
    assert io.append_ledger(io.read_ledger(spark, p), str(tmp_path / "copy")) and io.read_ledger(spark, str(tmp_path / "copy")).count() == io.read_ledger(spark, p).count()
    assert not io.append_ledger(io.read_ledger(spark, p), "nosuch://x/y") and not io.reset_ledger(spark, p, False) and io.reset_ledger(spark, p, True) and not os.path.exists(p)
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\rc")
    assert io.read_texts(spark, str(tmp_path / "t.txt")).first()["text"] == "a\nb\nc"
    out = str(tmp_path / "set")
    pairs_ = spark.createDataFrame([(" EN ", f" text  {k} ", "t", ["x"], "m") for k in range(5)], "language string, source string, target string, protected_spans array<string>, teacher_model string")
    rows = io.example_rows(pairs_, F.lit(5))
    assert rows.first()["id"] == pairs.fingerprint(rows.first()["source"])[:16]
    io.write_dataset(rows, out, 3)
    io.write_dataset(rows, out)
    assert io.read_dataset(spark, out).count() == 5 and io.unwritten(rows, spark, out).count() == 0
    r = spark.createDataFrame([('{"id": "1", "text": "hello there all"}',), ("nope",)], "value string")
    got = flows.answers(r).collect()
    assert got[0]["text"] == "hello there all" and got[0]["error"] is None and got[1]["error"] == "invalid request"


def test_streams(spark, tmp_path, book):
    src = str(tmp_path / "in")
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        f.writelines(json.dumps({"ts": float(k * 3600), "source": "cli" if k % 2 else "", "session": "s", "in_chars": 10, "out_chars": 4}) + "\n" for k in range(48))
    stream = spark.readStream.schema(LEDGER).json(src)
    q = flows.ledger_windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["source"], r["requests"], r["saved_chars"]) for r in spark.table("w").collect()} == {("cli", 12, 72), ("unknown", 12, 72)}
    texts = str(tmp_path / "texts")
    os.makedirs(texts)
    with open(f"{texts}/a.json", "w") as f:
        f.writelines(json.dumps({"id": k, "text": t}) + "\n" for k, t in enumerate(["one two three four", "one two three four", "quite another text here"]))
    s = spark.readStream.schema("id long, text string").json(texts)
    q = flows.fresh_examples(s).writeStream.outputMode("append").format("memory").queryName("f").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("f").collect()) == [0, 2]


def test_stream_misses_no_near_copy(spark, tmp_path, monkeypatch):
    rng = random.Random(19)
    full = (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    hashes, base = [], [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            h ^= 1 << b
        hashes.append(h)
        base += [h] if rng.random() < 0.2 else []
    monkeypatch.setattr(udfs, "simhash", lambda c: F.col(c).cast("long"))
    texts = str(tmp_path / "texts")
    os.makedirs(texts)
    s = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).json(texts)
    for n, part in enumerate((range(0, 70), range(70, 150))):
        with open(f"{texts}/{n}.json", "w") as f:
            f.writelines(json.dumps({"id": k, "text": str(signed(hashes[k]))}) + "\n" for k in part)
        q = flows.fresh_examples(s).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
    kept: list = []
    for k, h in enumerate(hashes):
        if not any(((h ^ hashes[j]) & full).bit_count() <= 3 for j in kept):
            kept.append(k)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == kept
    # only bits that parted rows before
    assert any(((h ^ g) >> 48) & 255 and (h ^ g).bit_count() <= 3 for h in hashes for g in hashes)


def test_sql_functions_and_salted_join(spark):
    names = udfs.register(spark)
    assert "tc_compress_rules" in names
    assert spark.sql("select tc_token_count('a b c') as n, tc_fingerprint('A') = tc_fingerprint('a') as same").first()[:] == (3, True)
    left = spark.range(1000).select("id", F.lit("hot").alias("k"))
    assert salted_join(left, spark.createDataFrame([("hot", 1)], "k string, v int"), "k", F.col("id")).where("v = 1").count() == 1000


def test_table_functions_and_bodies(spark):
    udfs.register(spark)
    assert [r["clause"] for r in spark.sql("select * from tc_clauses('a, b. c')").collect()] == ["a,", "b.", "c"]
    assert spark.sql("select count(*) from tc_source_chunks(repeat('word ', 100), 200)").first()[0] == 3
    from quillspark.functions import payloads

    up = payloads.rewrite_body('{"messages": [{"role": "user", "content": "ab"}, {"content": [{"type": "text", "text": "c"}, {"type": "image"}]}], "k": 1}', str.upper)
    assert json.loads(up) == {"messages": [{"role": "user", "content": "AB"}, {"content": [{"type": "text", "text": "C"}, {"type": "image"}]}], "k": 1}
    assert payloads.rewrite_body("nope", str.upper) == "nope" and json.loads(payloads.rewrite_body('{"input": ["a", 1]}', str.upper)) == {"input": ["A", 1]}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from quillspark.__main__ import main

    led = tmp_path / "l.jsonl"
    led.write_text('{"ts": 1.0, "in": 1000, "out": 200, "source": "cli", "session": "s"}\n')
    assert main(["gain", "--ledger", str(led)]) == 0 and "Tokens saved:    200" in capsys.readouterr().out
    assert main(["gain", "--ledger", str(led), "--oneline", "-s", "s"]) == 0 and capsys.readouterr().out == "200 saved · 80.0%\n"
    assert main(["gain", "--ledger", str(led), "--json"]) == 0 and '"saved_tokens": 200' in capsys.readouterr().out
    assert main(["gain", "--ledger", str(led), "--reset"]) == 1 and led.exists() and main(["gain", "--ledger", str(led), "--reset", "-y"]) == 0 and not led.exists()
    (tmp_path / "t.txt").write_text(CHECKPOINT)
    assert main(["checkpoint", str(tmp_path / "t.txt")]) == 0 and "Decision: keep the cache." in capsys.readouterr().out


def test_supervision_codes(spark):
    unit = "id string, start_off int, end_off int, text string, protected boolean, role string"
    schema = f"k int, source string, central_message string, units array<struct<{unit}>>, target_unit_ids array<string>, facts array<struct<id string, claim string, evidence_unit_ids array<string>, central boolean, required boolean>>, verification_questions array<struct<question string, answer_fact_ids array<string>>>"
    src = "Fix the bug. Ship it."
    u0, u1 = ("u0", 0, 12, "Fix the bug.", False, "core"), ("u1", 13, 21, "Ship it.", True, "action")
    fact, ask = ("f0", "bug", ["u0"], True, True), ("q?", ["f0"])
    good = [src, "fix", [u0, u1], ["u0", "u1"], [fact], [ask]]
    want = {
        0: (good, []),
        1: ([None, *good[1:]], ["source_missing"]),
        2: ([*good[:3], ["u0"], *good[4:]], ["missing_protected_units:['u1']"]),
        3: ([*good[:4], [], None], ["central_fact_missing", "selected_without_fact:['u0']"]),
        4: ([src, " ", [(*u0[:5], "x"), u1, u1, None, ("u3", 0, 5, "nope", None, "core")], ["u0", "u9", "u1"], good[4], good[5]],
            ["central_message_missing", "invalid_unit", "duplicate_unit:u1", "invalid_unit", "unit_evidence_mismatch:u3", "unknown_target_units:['u0', 'u9']", "unknown_fact_evidence:f0", "central_fact_missing",
             "selected_without_fact:['u0', 'u9']", "unknown_question_facts:['f0']"]),
        5: ([*good[:3], ["u1"], [fact, fact, ("f1", " ", ["u1"], None, None), ("f2", "c", ["u1"] * 9, None, None), None, ("f3", "c", ["u1"], None, None)], [ask, ("", ["f0"]), None, ("z", ["f3"])]],
            ["required_fact_not_selected:f0", "duplicate_fact:f0", "ungrounded_fact:f1", "fact_evidence_not_atomic:f2", "invalid_fact", "unanswerable_verification_question:q?", "invalid_verification_question", "invalid_verification_question"]),
        6: ([src, "m", None, None, None, None], ["central_fact_missing"]),
    }
    got = {r[0]: r[1] for r in datasets.supervision_rows(spark.createDataFrame([(k, *row) for k, (row, _) in want.items()], schema), "k").collect()}
    assert got == {k: codes for k, (_, codes) in want.items()}


def test_greedy_cover_and_renaming():
    item = lambda i, cost, facts, fixed=False: dict(id=i, token_cost=cost, fact_ids=facts, protected=fixed)
    items = [item("a", 2, ["x"]), item("b", 2, ["x"]), item("c", 5, ["y", "z"]), item("p", 9, ["w"], True), item("d", 1, ["z"])]
    assert pairs.minimum_context(items, {}, {"x"}) == ["b", "p"]
    assert pairs.minimum_context(items, {}, {"x"}, 0.2) == ["b", "c", "p", "d"]
    assert pairs.minimum_context(items, {"y": 0.5}, {"x"}, 0.2) == ["b", "p", "d"]
    out = code.compact_python("def f(value, other=1):\n    def g(value):\n        return value + other\n    return g(value), (lambda value: value)\n", names=True)
    space: dict = {}
    exec(out, space)
    assert space["f"](2)[0] == 3 and space["f"](2)[1](7) == 7 and "other" not in out


def test_annotated_rows(spark):
    note = {"unit_roles": {"u0": "central_claim"}, "central_message": "m", "facts": [{"id": "f", "claim": "c", "evidence_unit_ids": ["u0"], "central": True}]}
    rows = [(1, "Fix `a`. Nice day.", json.dumps(note)), (2, "Fix it.", "{"), (3, "Fix it.", json.dumps({**note, "unit_roles": {"u9": "core"}})), (4, "Fix `a`. Nice day.", json.dumps({**note, "facts": []}))]
    got = {r["k"]: r for r in datasets.annotated_rows(spark.createDataFrame(rows, "k int, t string, n string"), "k", "t", "n").collect()}
    assert got[1]["errors"] == [] and got[1]["target_unit_ids"] == ["u0"] and got[1]["units"][1]["role"] == "noise"
    assert got[2]["errors"][0].startswith("annotation:") and got[3]["errors"] == ["annotation:role of an unknown unit"] and "central_fact_missing" in got[4]["errors"]
