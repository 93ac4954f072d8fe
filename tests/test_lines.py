"""Line transforms against small known texts and plain-Python models."""

from pyspark.sql import functions as F

from quillspark.functions import lines


def out_of(spark, f, *texts, **kw):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, __extra string")
    rows = f(df, "text", **kw).orderBy("id").collect()
    assert all(r["__extra"] == "kept" for r in rows)
    return [r["out"] for r in rows]


def test_ansi(spark):
    df = spark.createDataFrame([("\x1b[31mERROR\x1b[0m: something failed",)], "t string")
    assert df.select(lines.strip_ansi(F.col("t"))).first()[0] == "ERROR: something failed"


def test_runs_and_inverse(spark):
    texts = ["a\na\na\nb\n", "a", "", None, "x\n\n\ny", "a\na\n", "\n", "ünï\nünï"]
    small = out_of(spark, lines.collapse_runs, *texts)
    assert small[0] == "a\n... (repeated 3 times)\nb\n" and small[2] == "" and small[3] is None
    assert out_of(spark, lines.expand_runs, *small) == texts


def test_grep_heading_and_inverse(spark):
    t = "src/a.py:1:x = 1\nsrc/a.py:7:y:z\nsrc/b.py:3:ok\nplain\n"
    (folded,) = out_of(spark, lines.search_heading, t)
    assert folded == "src/a.py\n1:x = 1\n7:y:z\nsrc/b.py\n3:ok\nplain\n" and len(folded) < len(t)
    assert out_of(spark, lines.search_unheading, folded) == [t]
    assert out_of(spark, lines.search_dir_heading, t) == ["src/\na.py:1:x = 1\na.py:7:y:z\nb.py:3:ok\nplain\n"]


def test_path_heading(spark):
    assert out_of(spark, lines.path_heading, "src/a.py\nsrc/b.py\nlib/c.py", "src/a.py\nnote") == ["src/\na.py\nb.py\nlib/\nc.py", "src/a.py\nnote"]


def test_spaces(spark):
    assert out_of(spark, lines.collapse_spaces, "    x  =   1  \n\n\n\ny\n", None, "") == ["    x = 1\n\ny", None, ""]


DIFF = "diff --git a/x b/x\nindex 1a..2b 100644\n--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n c1\n c2\n c3\n-old\n+new\n c4\n c5\n c6\n\\ No newline at end of file"


def test_diff(spark):
    (small, same) = out_of(spark, lines.compact_git_diff, DIFF, "a\nb")
    assert same == "a\nb" and "-old" in small and "+new" in small and " c2" in small and " c1" not in small and " c6" not in small
    assert set(small.split("\n")) <= set(DIFF.split("\n"))
    assert out_of(spark, lines.diff_strip_index, DIFF)[0].count("\nindex ") == 0


def test_logs(spark):
    log = "\n".join(["INFO step %d done" % k for k in range(20)] + ["ERROR disk 7 full", "ERROR disk 8 full"] + ["INFO step %d done" % k for k in range(5)])
    (small,) = out_of(spark, lines.compact_logs, log)
    assert "ERROR disk 7 full" in small and "ERROR disk 8 full" in small and len(small) < len(log) and "  ..." in small
    trace = "\n".join(["DEBUG a%d" % k for k in range(8)] + ["Traceback (most recent call last)", "  File x", "    boom", "", "DEBUG z", "DEBUG y", "DEBUG w"])
    assert "    boom" in out_of(spark, lines.compact_logs, trace)[0]
    assert out_of(spark, lines.compact_logs, "a\nb", None, "") == ["a\nb", None, ""]


def test_scores_and_failures(spark):
    rows = ["FATAL x", "WARN info", "info error", "12 passed", "plain", "    File \"a\", line 3", "debug"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(lines.line_score(F.col("t"))).collect()]
    assert got == [1.0, 0.7, 0.3, 0.9, 0.2, 0.8, 0.1]
    assert [r[0] for r in spark.createDataFrame([("all good",), ("a warning",), ("✗ bad",)], "t string").select(lines.is_failure(F.col("t"))).collect()] == [False, True, True]


def test_trim(spark):
    df = spark.createDataFrame([("x" * 50 + "y" * 50,), ("short",)], "t string")
    got = [r[0] for r in df.select(lines.trim_head_tail(F.col("t"), 40)).collect()]
    assert got[0].startswith("x" * 24 + "\n") and got[0].endswith("y" * 16) and "60 chars" in got[0] and got[1] == "short"


def test_native_cleanup_equals_kernel(spark):
    from quillspark.functions.spans import tidy

    texts = ["a  , b ; ; c", "  x\n\n\n\n y .", "\n, lead", "keep .name here .", "tab\tgap  !"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lines.cleanup(F.col("t"))).collect()] == [tidy(t) for t in texts]
