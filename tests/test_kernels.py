"""Kernels for spans, rules, payloads, code and pairs on known cases."""

import ast
import base64
import json
import random

import pytest

from quillspark.functions import code, pairs, payloads, spans


def texts(found, t):
    return [t[a:b] for a, b in found]


def test_rules():
    assert spans.compress_rules("Keep logs. Keep logs.\nsame line\nsame line") .count("Keep logs.") == 1
    assert spans.compress_rules("Actually alpha, in order to beta; gamma.") == "alpha, beta; gamma."
    assert spans.compress_rules("") == ""


def test_anchors():
    t = "You must never edit `conf` at https://a.b/c on 2024-01-02 in fooBar or src/x/y.py."
    got = texts(spans.anchors(t), t)
    for want in ("never", "`conf`", "https://a.b/c", "fooBar", "src/x/y.py"):
        assert want in got


def test_risk_sentences():
    t = "Do not deploy capture.py 3.12 today. Fine."
    assert texts(spans.risk_sentences(t), t) == ["Do not deploy capture.py 3.12 today."]
    assert spans.risk_sentences("file /a/b 3.5") == [] and spans.risk_sentences("not " + "x" * 200) == [] and len(spans.risk_sentences("not " + "x" * 200, 0)) == 1


def test_overlaps_match_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        o = spans.Overlaps(s)
        lo = rng.randint(0, 40)
        hi = lo + rng.randint(1, 6)
        assert o(lo, hi) == any(lo < b and hi > a for a, b in s if b > a)


def test_clauses_and_render():
    t = "API rápida, cache ativa; senha nunca exposta."
    assert texts(spans.clauses(t), t) == ["API rápida,", "cache ativa;", "senha nunca exposta."]
    t2 = "Keep this.\n\nDrop this. Keep that."
    p = spans.clauses(t2)
    assert spans.render(t2, p, [True, False, True]) == "Keep this.\nKeep that." and spans.render(t2, p, [True] * 3) == t2
    rows = ["| h |", "|---|", "| a |", "| b |", "text"]
    assert spans.keep_table_heads(rows, [False, False, False, True, False]) == [True, True, False, True, False]


def test_checkpoint_keep():
    k = spans.checkpoint_keep
    assert k("Implemented the parser.", False) and k("Next: add tests", False) and k("Only maintainers can deploy", False)
    assert not k("...", True) and not k("test_a PASSED", True) and k("test_a FAILED", False)
    assert not k("Here is the run:", True) and not k("Sure, happy to help", True) and k("uses fooBar", True) and not k("the weather is nice", False)


def test_base64():
    data = bytes(range(256)) * 4 + b"x" * 176
    out = payloads.compact_base64("before " + base64.b64encode(data).decode() + " after")
    assert "bytes=1200" in out and out.endswith(" after") and payloads.compact_base64("A" * 129) == "A" * 129


def test_json():
    items = [{"id": i, "status": "ok"} for i in range(50)]
    items[20]["status"] = "error"
    out = json.loads(payloads.compact_json(json.dumps(items)))
    assert [x["id"] for x in out[:3]] == [0, 1, 2] and out[-2]["id"] == 20 and out[-3]["id"] == 49 and "50 items" in out[-1]["_summary"]
    wrapped = "log: " + json.dumps(items) + " done"
    assert payloads.compact_json(wrapped).endswith(" done")
    long = payloads.compact_json(json.dumps({"a": "x" * 500}))
    assert "[500 chars]" in json.loads(long)["a"] and payloads.compact_json("no json") == "no json" and payloads.compact_json("[1, 2") == "[1, 2"
    assert payloads.identity({"a": 1, "b": 2}) == payloads.identity({"b": 2, "a": 1})
    for good, want in (({"status": "Error"}, True), ({"level": "fatal"}, True), ({"error": "timeout"}, True), ({"status": "ok"}, False), ({}, False)):
        assert payloads.is_error_item(good) is want
    assert payloads.leaves({"a": [1, {"b": 2}]}) == [1, 2]
    assert payloads.teacher_examples('```json\n{"examples": [1]}\n```') == [1] and payloads.first_object('say {"a": 1} x') == {"a": 1}


def test_blocks_round_trip():
    rng = random.Random(2)
    for _ in range(60):
        t = "\n".join(rng.choice(["alpha line", "beta line", "gamma line", ""]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n"])
        small = payloads.fold_blocks(t)
        assert payloads.unfold_blocks(small) == t and len(small) <= len(t)
    block = "first line here\nsecond line here\nthird line here\n"
    assert "repeats 3 lines" in payloads.fold_blocks(block + "other\n" + block)


def test_trim_output():
    assert payloads.trim_output("Sure! Let me look.\nThe answer is 4.\nHope this helps!") == "The answer is 4."
    ctx = "one two three four five six seven eight nine ten"
    assert payloads.trim_output(ctx + "\nnew fact", ctx) == "new fact" and payloads.echo_ratio("a b", ctx) == 0.0


def test_html():
    assert payloads.html_text("<p>A <b>b</b></p><script>x</script><li>c</li>") == "A b\nc"


def test_code():
    src = 'class A:\n    """doc"""\n    def f(self, value):\n        """d"""\n        # note\n        return value\n    def g(self):\n        pass\n'
    out = code.compact_python(src)
    assert "doc" not in out and "note" not in out and ast.parse(out)
    assert ast.parse(code.compact_python('def f():\n    """only"""\n')) and "(self, a)" in code.compact_python(src, names=True)
    js = "// it's\nconst a = 'x // y'; /* b */\nif (a) { }\nreturn (a + 1);\n"
    small = code.compact_js(js)
    assert "'x // y'" in small and "it's" not in small and "{}" in small and "return a + 1;" in small
    with pytest.raises(ValueError):
        code.compact_code("x", "cobol")
    assert code.compact_python("def (") == "def (" and code.without_comments("/* a\nb */\n// c\nd\n") == "d\n"


def test_alignment():
    al = pairs.align("Please keep API secret.", "keep API")
    assert al["tokens"] == ["Please", "keep", "API", "secret", "."] and al["labels"][1:3] == [1, 1] and al["offsets"][0] == [0, 6]
    assert pairs.align("a b", "x y z")["error"] == "low_coverage" and pairs.align("", "x")["error"] == "no_tokens"
    row = pairs.clause_row("Alpha runs fast. Beta is slow. Gamma ends.", "Alpha runs fast. Gamma ends.")
    assert row["labels"] == [1, 0, 1] and row["kept_units"] == 2
    assert pairs.token_subsequence("a b c", "a c") and not pairs.token_subsequence("a b", "b a") and pairs.token_recall("a b", "b") == 0.5


def test_set_cover():
    items = [dict(id="verbose", token_cost=20, fact_ids=["c", "a"], protected=False), dict(id="cause", token_cost=4, fact_ids=["c"], protected=False), dict(id="action", token_cost=3, fact_ids=["a"], protected=False)]
    assert pairs.minimum_context(items, {}, {"c", "a"}) == ["cause", "action"]
    with pytest.raises(ValueError, match="no evidence"):
        pairs.minimum_context([], {}, {"x"})


def test_transformations_and_rewrites():
    units = [dict(id="a", text="Use port 80.", fact_ids=["f"], protected=False), dict(id="b", text="Never delete.", fact_ids=["g"], protected=True)]
    step = lambda op, ids, out, cov: dict(operation=op, source_unit_ids=ids, output=out, covered_fact_ids=cov)
    assert pairs.transformation_errors(units, [step("keep", ["a"], "Use port 80.", ["f"])], {"f"}) == []
    assert "missing_required_facts:['g']" in pairs.transformation_errors(units, [step("keep", ["a"], "Use port 80.", ["f"])], {"g"})
    assert "invalid_drop:0" in pairs.transformation_errors(units, [step("drop", ["b"], "", [])], set())
    assert pairs.rewrite_reasons("x", "y", "binary") == ["binary_requires_decoder"] and pairs.rewrite_reasons("on 2024-01-02", "on 2024-01-03", "text")
    assert pairs.rewrite_reasons('{"a": 1}', '{"a": 2}', "json") and pairs.rewrite_reasons("a\nb\nc", "a\nc", "code") == []


def test_builder():
    assert pairs.fingerprint("A  b") == pairs.fingerprint("a B") and pairs.simhash("A  b c d") == pairs.simhash("a b C D")
    assert pairs.repeats_sentence("one two three four. one two three four.") and not pairs.repeats_sentence("a. a.")
    assert pairs.item_reject("fr", "x", "y") == "language" and pairs.item_reject("en", None, "y") == "missing_field"
    t = "".join(random.Random(3).choice("abc \n") for _ in range(3000))
    assert "".join(pairs.source_chunks(t, 200)) == t and max(map(len, pairs.source_chunks(t, 200))) <= 200
    assert pairs.article_chunks("aa\n\nbb", 1, 4) == ["aa", "bb"] and pairs.article_chunks("a", 10, 20) == []
    assert 1 <= pairs.word_id("Hello") < 8192 and pairs.word_id("hello") == pairs.word_id("HELLO")
    row = pairs.annotated("Fix `a`. Nice day.", {"unit_roles": {"u0": "central_claim"}, "central_message": "m", "facts": [{"id": "f", "claim": "c", "evidence_unit_ids": ["u0"], "central": True}]})
    assert row["units"][0]["role"] == "core" and row["units"][1]["role"] == "noise" and row["target_unit_ids"] == ["u0"]
    assert pairs.contains_exact("v 3.1 ok", "3.1") and not pairs.contains_exact("v 3.12", "3.1") and pairs.contains_natural("Ａ  b , c", "a b, C")
