"""Line transforms as Catalyst expressions: one pass over the rows, no shuffle, no Python.

Each function takes a DataFrame and the name of a text column and adds ``out``. A text
is split once into an array of lines; what an expression refers to more than once is a
column of its own, so it is worked out once per row. ``null`` stays ``null``; the empty
string stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: formats and patterns of the folded forms
ANSI = r"\x1b\[[0-9;]*m"
GREP_ROW = r"(?dU)^([^\n:]+):(\d+):(.*)$"
PATH_ROW = r"(?dU)^((?:\.{0,2}/)?(?:[^/\s:]+/)+)([^/\s:]+)$"
INDEX_ROW = r"^index [0-9a-fA-F]+\.\.[0-9a-fA-F]+( [0-7]+)?$"
DIFF_META = ("diff --git ", "index ", "--- ", "+++ ", "@@ ", "new file mode ", "deleted file mode ", "similarity index ", "rename from ", "rename to ")
NO_NEWLINE = "\\ No newline at end of file"
LEVEL = r"(?idU)\b(FATAL|ERROR|ERR|FAILED|FAIL|CRITICAL|WARN(?:ING)?|INFO|DEBUG|TRACE)\b"
LEVEL_WEIGHTS = {"FATAL": 1.0, "ERROR": 1.0, "ERR": 1.0, "FAILED": 1.0, "FAIL": 1.0, "CRITICAL": 1.0, "WARN": 0.7, "WARNING": 0.7, "INFO": 0.3, "DEBUG": 0.1, "TRACE": 0.1}
TRACE = r"(?idU)^\s*(Traceback \(most recent call last\)|at .+\(.+:\d+:\d+\)|File \".+\", line \d+|.*Error:|.*Exception:|.*Failed to)"
SUMMARY = r"(?idU)^\s*(?:\d+\s+(?:passed|failed|errors?|skipped|warnings?)|=+ .* =+$|total|summary|(?:test|build) result)"
TRACE_HEAD = "Traceback (most recent call last)"
GAP = "  ..."
FAILURE = r"(?i)\b(?:error|failed|failure|fatal|panic|traceback|exception|warn(?:ing)?)\b|✗|FAILED|Segmentation fault"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def has_trailing(text: Column) -> Column:
    return text.endswith("\n")


def body_lines(text: Column) -> Column:
    """The lines of a text; a final newline ends the last line and does not open another."""
    return F.split(F.when(has_trailing(text), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n", -1)


def rejoin(lines: Column, text: Column) -> Column:
    """Lines back to text, with a final newline where ``text`` has one."""
    return F.concat(F.array_join(lines, "\n"), F.when(has_trailing(text), F.lit("\n")).otherwise(F.lit("")))


def universal_lines(text: Column) -> Column:
    """Lines at any Unicode line break, without an empty last one."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)


def is_diff(text: Column) -> Column:
    return text.rlike(r"(?m)(?:\A|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])diff --git ")


def line_level(line: Column) -> Column:
    """The first level a line names, upper case; empty if none."""
    return F.upper(F.regexp_extract(line, LEVEL, 1))


def line_score(line: Column, level: Column | None = None) -> Column:
    """Weight of a log line; the first level named decides, then traces, then summaries. ``level``: the level, if at hand."""
    level = line_level(line) if level is None else level
    plain = F.when(line.rlike(TRACE), 0.8).when(line.rlike(SUMMARY), 0.9).otherwise(0.2)
    weights = F.create_map(*[F.lit(x) for pair in LEVEL_WEIGHTS.items() for x in pair])
    return F.coalesce(weights[level], plain)


def is_failure(text: Column) -> Column:
    return text.rlike(FAILURE)


def _lines(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("__q_t", F.col(col)).withColumn("__q_l", body_lines(F.col("__q_t"))).withColumn("__q_n", F.size("__q_l"))


def _done(df: DataFrame, result: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col("__q_t") == "", F.col("__q_t")).otherwise(result)).drop(*[c for c in df.columns if c.startswith("__q_")])


def collapse_spaces(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """Squeeze blanks inside lines, keep indentation, drop trailing blanks, at most one empty line."""
    x = df.withColumn("__q_t", F.col(col)).withColumn("__q_l", universal_lines(F.col("__q_t")))

    def tidy(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        indent = F.when(bare == "", F.lit("")).otherwise(F.substring(line, F.lit(1), F.length(line) - F.length(bare)))
        return F.regexp_replace(F.concat(indent, F.regexp_replace(bare, r"(?U)[^\S\n]{2,}", " ")), r"[ \t]+$", "")

    return _done(x, F.regexp_replace(F.array_join(F.transform("__q_l", tidy), "\n"), r"\n{3,}", "\n\n"), out)


def collapse_runs(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """Two or more equal lines in a row become the line and a count."""
    x = _lines(df, col)
    x = x.withColumn("__q_s", F.filter(F.sequence(F.lit(0), F.col("__q_n") - 1), lambda i: (i == 0) | (F.get("__q_l", i) != F.get("__q_l", i - 1))))

    def run(at: Column, k: Column) -> Column:
        count = F.coalesce(F.get("__q_s", k + 1), F.col("__q_n")) - at
        line = F.get("__q_l", at)
        return F.when(count > 1, F.array(line, F.concat(F.lit("... (repeated "), count.cast("string"), F.lit(" times)")))).otherwise(F.array(line))

    return _done(x, rejoin(F.flatten(F.transform("__q_s", run)), F.col("__q_t")), out)


def expand_runs(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """Inverse of ``collapse_runs`` for texts without lines that look like markers."""
    x = _lines(df, col)
    marker = r"^\.\.\. \(repeated (\d+) times\)$"

    def spread(line: Column, i: Column) -> Column:
        after = F.regexp_extract(F.coalesce(F.get("__q_l", i + 1), F.lit("")), marker, 1)
        mine = line.rlike(marker) & (i > 0)
        return F.when(mine & ~F.coalesce(F.get("__q_l", i - 1), F.lit("")).rlike(marker), F.array().cast("array<string>")).when(after != "", F.array_repeat(line, after.cast("int"))).otherwise(F.array(line))

    return _done(x, rejoin(F.flatten(F.transform("__q_l", spread)), F.col("__q_t")), out)


def _headed(df: DataFrame, col: str, out: str, pattern: str, key: Column, rest, matches) -> DataFrame:
    """Rows that share a key in a row are put under one heading line."""
    x = _lines(df, col).withColumn("__q_k", F.transform("__q_l", lambda line: F.when(matches(line), key(line))))

    def fold(line: Column, i: Column) -> Column:
        k = F.get("__q_k", i)
        before = F.when(i > 0, F.get("__q_k", i - 1))
        return F.when(k.isNull(), F.array(line)).when(k.eqNullSafe(before), F.array(rest(line))).otherwise(F.array(k, rest(line)))

    return _done(x, rejoin(F.flatten(F.transform("__q_l", fold)), F.col("__q_t")), out)


def search_heading(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """``path:line:content`` rows under one line with the path."""
    return _headed(df, col, out, GREP_ROW, lambda s: F.regexp_extract(s, GREP_ROW, 1), lambda s: F.regexp_replace(s, r"(?d)^[^\n:]+:", ""), lambda s: s.rlike(GREP_ROW))


def search_dir_heading(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """``dir/base:line:content`` rows under one line with the directory."""
    head = r"(?d)^([^\n:]*/)[^/\n:]*:\d+:"
    return _headed(df, col, out, GREP_ROW, lambda s: F.regexp_extract(s, head, 1), lambda s: F.regexp_replace(s, r"(?d)^[^\n:]*/", ""), lambda s: s.rlike(GREP_ROW) & s.rlike(head))


def path_heading(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """A listing of paths under its directories, if it has two paths or more."""
    x = _headed(df, col, "__q_folded", PATH_ROW, lambda s: F.regexp_extract(s, PATH_ROW, 1), lambda s: F.regexp_extract(s, PATH_ROW, 2), lambda s: s.rlike(PATH_ROW))
    many = F.size(F.filter(body_lines(F.col(col)), lambda s: s.rlike(PATH_ROW))) >= 2
    return x.withColumn(out, F.when(many, F.col("__q_folded")).otherwise(F.col(col))).drop("__q_folded")


def search_unheading(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """Inverse of ``search_heading``: data rows take the heading above them."""
    data = r"(?dU)^\d+:.*$"
    x = _lines(df, col).withColumn("__q_d", F.transform("__q_l", lambda s: s.rlike(data)))
    # a heading is a line that is no data row and stands before one; data rows in a row belong to it
    x = x.withColumn("__q_h", F.filter(F.sequence(F.lit(0), F.col("__q_n") - 1), lambda i: ~F.get("__q_d", i)))
    owner = lambda i: F.array_max(F.filter("__q_h", lambda j: j < i))

    def put(line: Column, i: Column) -> Column:
        is_head = ~F.get("__q_d", i) & F.coalesce(F.get("__q_d", i + 1), F.lit(False))
        o = owner(i)
        return F.when(is_head, F.array().cast("array<string>")).when(F.get("__q_d", i) & o.isNotNull(), F.array(F.concat_ws(":", F.get("__q_l", o), line))).otherwise(F.array(line))

    return _done(x, rejoin(F.flatten(F.transform("__q_l", put)), F.col("__q_t")), out)


def diff_strip_index(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    x = _lines(df, col)
    return _done(x, rejoin(F.filter("__q_l", lambda s: ~s.rlike(INDEX_ROW)), F.col("__q_t")), out)


def compact_git_diff(df: DataFrame, col: str, out: str = "out", context: int = 2) -> DataFrame:
    """Headers, changes and ``context`` lines round them; texts that are no diff are returned as they are."""
    x = df.withColumn("__q_t", F.col(col)).withColumn("__q_l", universal_lines(F.col("__q_t"))).withColumn("__q_n", F.size("__q_l"))
    changed = lambda s: (s.startswith("+") | s.startswith("-")) & ~s.startswith("+++") & ~s.startswith("---")
    x = x.withColumn("__q_c", F.transform("__q_l", changed))
    near = lambda i: F.exists(F.slice("__q_c", F.greatest(i - context, F.lit(0)) + 1, F.least(i + context, F.col("__q_n") - 1) - F.greatest(i - context, F.lit(0)) + 1), lambda c: c)

    def wanted(s: Column, i: Column) -> Column:
        meta = F.lit(False)
        for p in DIFF_META:
            meta = meta | s.startswith(p)
        tail = (s == NO_NEWLINE) & F.coalesce(F.get("__q_c", i - 1), F.lit(False))
        return meta | near(i) | tail

    kept = F.array_join(F.filter("__q_l", wanted), "\n")
    return _done(x, F.when(is_diff(F.col("__q_t")), kept).otherwise(F.col("__q_t")), out)


def compact_logs(df: DataFrame, col: str, out: str = "out") -> DataFrame:
    """Errors, warnings, summaries, trace heads, both ends and the first line of every pattern.

    Lines below 0.8 are kept once per pattern (digits alike); those kept for their weight or
    place go before those kept only as a new pattern. The first of each pattern is found
    by one sort per text.
    """
    x = df.withColumn("__q_t", strip_ansi(F.col(col))).withColumn("__q_l", body_lines(F.col("__q_t"))).withColumn("__q_n", F.size("__q_l"))
    x = x.withColumn("__q_h", F.transform("__q_l", lambda s: F.when(F.regexp_replace(s, r"(?U)\s+", "") == "", F.lit(0)).when(s.contains(TRACE_HEAD), F.lit(2)).otherwise(F.lit(1))))

    def in_trace(i: Column) -> Column:
        h = lambda k: F.coalesce(F.get("__q_h", i - k), F.lit(0))
        full = lambda k: h(k) > 0
        return (h(0) == 2) | (full(0) & ((h(1) == 2) | (full(1) & ((h(2) == 2) | (full(2) & (h(3) == 2))))))

    # the weights are a column of their own: what a lambda refers to twice would be worked out twice
    x = x.withColumn("__q_c", F.transform("__q_l", lambda s: line_score(s)))

    def mark(s: Column, i: Column) -> Column:
        score = F.get("__q_c", i)
        held = (score >= 0.7) | (i < 2) | (i >= F.col("__q_n") - 2) | in_trace(i)
        tier = F.when(held & (score >= 0.8), 0).when(held, 1).when(score.between(0.2, 0.79), 2).otherwise(3)
        key = F.regexp_replace(F.regexp_replace(s, r"(?U)\d+", "N"), r"(?U)^\s+|\s+$", "")
        return F.struct(key.alias("k"), tier.alias("r"), i.alias("i"))

    x = x.withColumn("__q_m", F.transform("__q_l", mark))
    x = x.withColumn("__q_o", F.array_sort(F.filter("__q_m", lambda m: m["r"].isin(1, 2))))
    first = F.filter("__q_o", lambda m, j: (j == 0) | (F.get("__q_o", j - 1)["k"] != m["k"]))
    x = x.withColumn("__q_i", F.array_sort(F.concat(F.transform(first, lambda m: m["i"]), F.transform(F.filter("__q_m", lambda m: m["r"] == 0), lambda m: m["i"]))))

    def emit(i: Column, k: Column) -> Column:
        line = F.get("__q_l", i)
        gap = (i + 1 < F.col("__q_n")) & (F.coalesce(F.get("__q_i", k + 1), F.lit(-1)) != i + 1)
        return F.when(gap, F.array(line, F.lit(GAP))).otherwise(F.array(line))

    short = rejoin(F.flatten(F.transform("__q_i", emit)), F.col("__q_t"))
    x = x.withColumn("__q_r", short)
    return _done(x, F.when((F.col("__q_n") >= 10) & (F.length("__q_r") < F.length("__q_t")), F.col("__q_r")).otherwise(F.col("__q_t")), out)


def trim_head_tail(text: Column, most: int) -> Column:
    """Both ends of an over-long text, 60 : 40, with a note of what was cut (code points)."""
    head = int(most * 0.6)
    removed = (F.length(text) - most).cast("string")
    cut = F.concat(F.substring(text, 1, head), F.lit("\n…["), removed, F.lit(" chars trimmed]…\n"), F.substring(text, -(most - head), most - head))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def cleanup(text: Column) -> Column:
    """Tidy what removals leave: blanks, empty lines, blanks before stops, repeated and leading stops."""
    t = F.regexp_replace(text, r"(?m)^([ \t]*)$", "")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda s: F.concat(F.regexp_extract(s, r"^([ \t]*)", 1), F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[ \t]*", ""), r"[ \t]+", " "), r"(?U)\s+$", ""))), "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+([,;:!?]|\.(?![A-Za-z_]))", "$1")
    t = F.regexp_replace(t, r"(?U)([,;])(?:\s*[,;])+", "$1")
    t = F.regexp_replace(t, r"(?U)(\A|\n)\s*[,;:]\s*", "$1")
    return F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")
