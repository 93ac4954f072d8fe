"""One query per operator over the project's tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lines, udfs
from quillspark.operators import compaction, datasets, evaluate, ledger, neardup, policy, scorer
from quillspark.operators.spread import spread_out
from quillspark.session import table
from quillspark.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PROJECT, SESSION_DAY, NOW = "/work/atlas/api", "2025-03-01", 1760000000.0
POLICY = policy.Policy(min_chars=300, keep_recent=2, budget_ratio=0.5)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", *cols)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ledger")


# ---- ledger

@query
def ledger_summary(spark, sf):
    return ledger.summary(_ledger(spark, sf))


@query
def ledger_by_source(spark, sf):
    return ledger.by_key(_ledger(spark, sf), "source")


@query
def ledger_by_project(spark, sf):
    return ledger.by_key(_ledger(spark, sf), "cwd")


@query
def ledger_by_session(spark, sf):
    return ledger.summary(_ledger(spark, sf), "session")


@query
def ledger_by_day(spark, sf):
    return ledger.by_day(_ledger(spark, sf))


@query
def ledger_saved_on_day(spark, sf):
    return ledger.saved_on(_ledger(spark, sf), SESSION_DAY)


@query
def ledger_top_projects(spark, sf):
    return ledger.top_groups(_ledger(spark, sf), "cwd")


@query
def ledger_recent_days(spark, sf):
    return ledger.recent_days(_ledger(spark, sf))


@query
def ledger_sparkline(spark, sf):
    return ledger.sparkline(_ledger(spark, sf))


@query
def ledger_project_scope(spark, sf):
    return ledger.summary(ledger.in_project(_ledger(spark, sf), PROJECT))


@query
def ledger_since_days(spark, sf):
    return ledger.summary(ledger.since_days(_ledger(spark, sf), NOW, 90))


@query
def ledger_one_line(spark, sf):
    return ledger.one_line(_ledger(spark, sf), SESSION_DAY)


@query
def ledger_windows(spark, sf):
    return flows.ledger_windows(_ledger(spark, sf))


@query
def ledger_sessions(spark, sf):
    return flows.session_totals(_ledger(spark, sf))


# ---- line transforms

@query
def strip_ansi(spark, sf):
    return _docs(spark, sf).select("doc_id", lines.strip_ansi(F.col("text")).alias("out"))


def _line_query(f):
    def run(spark, sf):
        return f(_docs(spark, sf), "text").select("doc_id", "out")

    run.__name__ = f.__name__
    return query(run)


for _f in (lines.collapse_spaces, lines.collapse_runs, lines.search_heading, lines.search_dir_heading, lines.path_heading, lines.diff_strip_index, lines.compact_git_diff, lines.compact_logs):
    _line_query(_f)


@query
def expand_runs(spark, sf):
    x = lines.collapse_runs(_docs(spark, sf), "text", "small")
    x = lines.expand_runs(x, "small")
    return x.groupBy(F.coalesce(F.col("out") == F.col("text"), F.col("text").isNull()).alias("restored")).agg(F.count(F.lit(1)).alias("n"))


@query
def search_unheading(spark, sf):
    x = lines.search_heading(_texts(spark, sf), "text", "small")
    return lines.search_unheading(x, "small").select("doc_id", "out")


@query
def log_line_scores(spark, sf):
    x = _texts(spark, sf).select("doc_id", F.explode(lines.body_lines(lines.strip_ansi(F.col("text")))).alias("line"))
    return x.groupBy("doc_id", lines.line_score(F.col("line")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query
def cleanup_text(spark, sf):
    return _docs(spark, sf).select("doc_id", lines.cleanup(F.col("text")).alias("out"))


@query
def routes(spark, sf):
    t = F.col("text")
    route = F.when(lines.is_diff(t), "diff").when(F.length(t) < 10, "tiny").when(F.length(t) < 200, "short").otherwise("model")
    return _texts(spark, sf).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def head_tail_trim(spark, sf):
    return _texts(spark, sf).select("doc_id", lines.trim_head_tail(F.col("text"), 500).alias("out"), lines.estimate_tokens(F.col("text")).alias("tokens"))


@query
def fold_blocks(spark, sf):
    x = spread_out(_texts(spark, sf)).withColumn("small", udfs.fold_blocks("text"))
    x = x.withColumn("back", udfs.unfold_blocks("small"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("small")).alias("chars"), F.count_if(F.col("back") == F.col("text")).alias("restored"))


@query
def trim_model_output(spark, sf):
    turns = table(spark, sf, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", udfs.trim_output("text").alias("out"))


@query
def base64_payloads(spark, sf):
    x = _texts(spark, sf).withColumn("out", udfs.compact_base64("text"))
    return x.where("out <> text").select("doc_id", "out")


@query
def json_payloads(spark, sf):
    x = _texts(spark, sf).withColumn("out", udfs.compact_json("text"))
    return x.where("out <> text").select("doc_id", "out")


@query
def json_routing(spark, sf):
    x = _docs(spark, sf, "kind").where("kind = 'json' and text is not null")
    return x.select("doc_id", udfs.routable_json("text").alias("routable"), udfs.error_item("text").alias("is_error"), udfs.json_identity("text").alias("identity"))


@query
def code_comments(spark, sf):
    return _docs(spark, sf, "kind").where("kind = 'code' and text is not null").select("doc_id", udfs.compact_js("text").alias("out"), udfs.without_comments("text").alias("plain"))


@query
def rule_compression(spark, sf):
    x = spread_out(_texts(spark, sf))
    return x.select("doc_id", udfs.compress_rules("text").alias("out"), udfs.token_count("text").alias("tokens"))


@query
def anchor_spans(spark, sf):
    x = spread_out(_texts(spark, sf)).select("doc_id", udfs.protected_spans("text").alias("a"), udfs.risk_spans("text").alias("r"), udfs.sentence_spans("text").alias("s"))
    return x.select("doc_id", F.size("a").alias("n_anchors"), F.size("r").alias("n_risk"), F.size("s").alias("n_sentences"))


# ---- conversations and policy

def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _once(spark, sf):
    """Turns sent twice count once: the first to arrive."""
    return neardup.first_seen(_turns(spark, sf), F.struct("conv_id", "turn"), "received_at")


@query
def turn_recency(spark, sf):
    return policy.with_recency(_once(spark, sf), "conv_id", "turn", POLICY).select("conv_id", "turn", "from_end", "is_recent")


@query
def conversation_budget(spark, sf):
    return policy.conversation_budget(_turns(spark, sf), "conv_id", "text", 1000, POLICY)


@query
def turn_failures(spark, sf):
    return _turns(spark, sf).where("text is not null").groupBy("conv_id").agg(F.count_if(lines.is_failure(F.col("text"))).alias("n_failures"), F.count_if(policy.should_consider(F.col("text"), POLICY)).alias("n_considered"))


@query
def eligible_turns(spark, sf):
    x = policy.eligible_turns(_once(spark, sf), "conv_id", "turn", "role", "text", 1000, POLICY)
    return x.groupBy("conv_id").agg(F.count_if("eligible").alias("n_eligible"), F.count(F.lit(1)).alias("n_turns"))


@query
def part_routes(spark, sf):
    kinds = _turns(spark, sf).select(F.lower(F.trim("role")).alias("role"))
    kind = F.when(F.col("role") == "tool", "tool-result").otherwise("text")
    return kinds.groupBy(policy.part_route(kind, F.lit("text")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query
def checkpoint(spark, sf):
    """Old, eligible turns become checkpoints, once per payload; each conversation's estimate before and after."""
    x = policy.eligible_turns(_once(spark, sf), "conv_id", "turn", "role", "text", 1000, POLICY)

    def work(payloads: DataFrame) -> DataFrame:
        return compaction.checkpoint(spread_out(payloads), "payload").withColumnRenamed("text_out", "small")

    done = policy.once_per_payload(x.where("eligible").select("conv_id", "turn", "text"), "text", "small", work)
    done = done.withColumn("final", policy.keep_if_smaller(F.col("text"), F.col("small")))
    return done.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(lines.estimate_tokens(F.col("text"))).alias("tokens_before"), F.sum(lines.estimate_tokens(F.col("final"))).alias("tokens_after"))


@query
def checkpoint_documents(spark, sf):
    return compaction.checkpoint(spread_out(_docs(spark, sf)), "text").select("doc_id", "text_out", "units", "kept", "protected", "ratio")


def _clause_score(spark, sf):
    return scorer.default_score(scorer.labelled_clauses(table(spark, sf, "clause_rows"), "id"))


@query
def compact_documents(spark, sf):
    x = compaction.compact(spread_out(_docs(spark, sf)), "text", _clause_score(spark, sf))
    return x.select("doc_id", "units", "kept", "protected", "ratio")


@query
def clause_split(spark, sf):
    return compaction.clause_rows(_docs(spark, sf), "doc_id", "text")


@query
def checkpoint_status(spark, sf):
    x = compaction.checkpoint_status(_docs(spark, sf), "doc_id", "text")
    flags = ["is_done", "is_next", "is_decision", "is_fail", "is_constraint", "is_narration", "is_label", "is_tool_noise", "keep_status"]
    return x.groupBy("doc_id").agg(*[F.count_if(f).alias(f) for f in flags])


@query
def stage_metrics(spark, sf):
    x = lines.compact_logs(_docs(spark, sf), "text", "logs")
    x = lines.compact_git_diff(x, "logs", "diff")
    x = lines.collapse_runs(x, "diff", "runs")
    return evaluate.stage_metrics(x, [("text", "logs"), ("logs", "diff"), ("diff", "runs")])


# ---- duplicates

@query
def exact_duplicates(spark, sf):
    return neardup.exact_groups(_docs(spark, sf), "doc_id", "text")


@query
def simhash_pairs(spark, sf):
    return neardup.with_copies(spread_out(_docs(spark, sf)), "doc_id", "text")


@query
def simhash_accepted(spark, sf):
    return neardup.accept_in_order(neardup.banded(spread_out(_docs(spark, sf)), "doc_id", "text"))


@query
def first_accepted(spark, sf):
    ex = table(spark, sf, "examples").select("ex_id", "source")
    return neardup.take_accepted(ex, "ex_id", "source", 100).select("ex_id")


@query
def ngram_overlap(spark, sf):
    ex = table(spark, sf, "examples").select("ex_id", "source")
    return neardup.ngram_overlap(_texts(spark, sf), ex, "doc_id", "text", "source")


@query
def repeated_sentences(spark, sf):
    ex = table(spark, sf, "examples").where("target is not null")
    return ex.select("ex_id", neardup.repeated_sentences(F.col("target")).alias("repeats"))


@query
def new_payloads(spark, sf):
    ex = table(spark, sf, "examples").where("source is not null")
    return neardup.without_seen(ex.where("batch_no > 0").select("ex_id", "id"), ex.where("batch_no = 0"), "id")


@query
def first_rows(spark, sf):
    ex = table(spark, sf, "examples").where("id is not null").select("ex_id", "id", "batch_no")
    return neardup.first_seen(ex, F.col("id"), "batch_no", "ex_id")


# ---- datasets

@query
def alignment(spark, sf):
    ex = table(spark, sf, "examples").where("source is not null and target is not null")
    x = datasets.aligned(spread_out(ex), "source", "target", "protected_spans")
    return x.select("ex_id", "alignment.coverage", "alignment.kept", "alignment.fixed", "alignment.error", F.size("alignment.tokens").alias("n_tokens"))


@query
def clause_label_rows(spark, sf):
    x = datasets.clause_labels(spread_out(table(spark, sf, "clause_rows")), "source", "target")
    return x.select("id", "language", "labelled.labels", "labelled.unit_count", "labelled.target_coverage", "labelled.error")


@query
def clause_label_stats(spark, sf):
    x = datasets.clause_labels(spread_out(table(spark, sf, "clause_rows")), "source", "target")
    return datasets.label_stats(x, "language")


@query
def sentence_labels(spark, sf):
    ex = table(spark, sf, "examples").where("source is not null and target is not null")
    return spread_out(ex).select("ex_id", udfs.sentence_labels("source", "target").alias("labels"))


@query
def supervision_errors(spark, sf):
    return datasets.supervision_rows(table(spark, sf, "msc"), "row_id").select("row_id", F.explode("errors").alias("error"))


@query
def supervision_references(spark, sf):
    return datasets.unknown_targets(table(spark, sf, "msc"), "row_id")


@query
def minimum_context(spark, sf):
    """Units of each supervision row that prove its required facts at least cost."""
    msc = table(spark, sf, "msc").where("units is not null and facts is not null")
    u = msc.select("row_id", F.posexplode("units").alias("pos", "u"), "facts")
    facts_of = F.transform(F.filter("facts", lambda f: F.array_contains(f["evidence_unit_ids"], F.col("u.id"))), lambda f: f["id"])
    c = u.select("row_id", "pos", F.col("u.id").alias("id"), lines.estimate_tokens(F.col("u.text")).cast("int").alias("token_cost"), facts_of.alias("fact_ids"), F.coalesce("u.protected", F.lit(False)).alias("protected"))
    f = msc.select("row_id", F.explode("facts").alias("f")).select("row_id", F.col("f.id").alias("fact"), F.lit(1.0).alias("weight"), F.coalesce("f.required", F.lit(False)).alias("required"))
    return datasets.minimum_context(c, "row_id", f)


@query
def group_keys(spark, sf):
    msc = table(spark, sf, "msc")
    return msc.groupBy(datasets.group_key(F.col("id")).alias("group_key")).agg(F.count(F.lit(1)).alias("n"))


@query
def hash_split(spark, sf):
    msc = table(spark, sf, "msc").select("row_id", "id")
    return datasets.hash_split(msc, datasets.group_key(F.col("id")), 0.1, 7).select("row_id", "is_validation")


@query
def training_windows(spark, sf):
    msc = table(spark, sf, "msc").where("units is not null and target_unit_ids is not null").withColumn("key", F.col("row_id").cast("string"))
    x = datasets.windows(msc, "key", "units", datasets.target_labels(), 4)
    return x.select("window_id", F.size("texts").alias("n_units"), F.aggregate("labels", F.lit(0), lambda a, v: a + v).alias("n_kept"))


@query
def usable_training_rows(spark, sf):
    return datasets.usable_rows(table(spark, sf, "clause_rows"), "labels").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query
def item_rejects(spark, sf):
    ex = spread_out(table(spark, sf, "examples"))
    r = datasets.reject_reason(F.col("language"), F.col("source"), F.col("target"), lo=0.15, hi=0.6, least=40, most=700)
    return ex.select("ex_id", r.alias("reason"))


@query
def source_chunks(spark, sf):
    x = _texts(spark, sf).select("doc_id", F.posexplode(udfs.source_chunks(1000)("text")).alias("k", "chunk"))
    return x.select("doc_id", "k", F.length("chunk").alias("n_chars"))


@query
def article_rows(spark, sf):
    x = datasets.long_rows(_docs(spark, sf, "source", "kind").where("kind = 'article' and text is not null").withColumn("title", F.col("doc_id").cast("string")), "title", "source", "text", 500, 1500)
    return x.select("id", "chunk", F.size("units").alias("n_units"), F.aggregate("labels", F.lit(0), lambda a, v: a + v).alias("n_kept"))


# the parameters of a small generator run
PHRASES = [
    ("en", ["Ship the release.", "Please review it.", "Is it safe?", "Run the tests.", "Then tag it.", "Never skip the review.", "You may merge.", "Do not force push.", "Safety goes first."], ["Run the tests.", "Check the log."], "It rained again."),
    ("pt", ["Publique a versão.", "Revise, por favor.", "É seguro?", "Rode os testes.", "Depois marque.", "Nunca pule a revisão.", "Pode mesclar.", "Não force o envio.", "Segurança primeiro."], [], "Choveu de novo."),
]


@query
def policy_rows(spark, sf):
    phrases = spark.createDataFrame(PHRASES, "language string, keep array<string>, commands array<string>, noise string")
    x = datasets.policy_rows(spark, phrases, 0, 40)
    return x.select("id", "language", F.size("units").alias("n_units"), F.size("target_unit_ids").alias("n_kept"), F.length("source").alias("n_chars"))


@query
def chat_bodies(spark, sf):
    """Requests made of the turns, with their text contents compacted."""
    body = F.to_json(F.struct(F.array(F.struct(F.lower(F.trim("role")).alias("role"), F.col("text").alias("content"))).alias("messages")))
    x = _once(spark, sf).where("text is not null").withColumn("body", body)
    return x.select("conv_id", "turn", udfs.rewrite_body("body").alias("out"))


# ---- evaluation

@query
def evaluation_gate(spark, sf):
    """The gate over the checkpoints of the sources, against their targets."""
    ex = table(spark, sf, "examples").where("source is not null and target is not null")
    ex = ex.select(F.lower(F.substring(F.trim("language"), 1, 2)).alias("language"), "source", "target", "protected_spans")
    x = compaction.checkpoint(spread_out(ex), "source")
    return evaluate.gate(evaluate.measured(x, "source", "text_out", "target", "protected_spans"), "language")


@query
def language_latency(spark, sf):
    x = _ledger(spark, sf).where("ms is not null and in_chars > 0 and out_chars is not null and units > 0 and kept is not null").withColumn("source", ledger.named("source")).withColumn("reduction", 1 - F.col("out_chars") / F.col("in_chars"))
    return evaluate.by_language(x, "source", "reduction", "ms", "units", "kept")


@query
def latency_p95(spark, sf):
    return evaluate.percentile_floor(_ledger(spark, sf), "ms")


def _scores(spark, sf):
    x = scorer.labelled_clauses(table(spark, sf, "clause_rows"), "id")
    return x.select(F.least(F.lit(0.999), F.length("clause") / 100.0).alias("score"), F.col("label").cast("int").alias("label"))


@query
def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(_scores(spark, sf), "score", "label")


@query
def chosen_threshold(spark, sf):
    return evaluate.chosen_threshold(evaluate.threshold_sweep(_scores(spark, sf), "score", "label"))


@query
def entity_preservation(spark, sf):
    x = lines.compact_logs(_texts(spark, sf), "text")
    return evaluate.entity_preservation(x, "doc_id", "text", "out")


@query
def critical_facts(spark, sf):
    x = lines.compact_logs(_texts(spark, sf), "text")
    return evaluate.critical_facts(x, "doc_id", "text", "out")


@query
def tfidf_similarity(spark, sf):
    ex = table(spark, sf, "examples").where("source is not null and target is not null")
    return evaluate.tfidf_cosine(ex, "ex_id", "source", "target").select("ex_id", F.round("cosine", 6).alias("cosine"))


@query
def domain_recall(spark, sf):
    x = _docs(spark, sf, "kind").where("text is not null and kind in ('diff', 'log')")
    x = lines.compact_git_diff(lines.compact_logs(x, "text", "logs"), "logs")
    kind = F.when(F.col("kind") == "diff", "git_diff").otherwise("logs")
    return x.select("doc_id", F.round(evaluate.domain_recall(x, kind, "text", "out"), 6).alias("recall"))


@query
def rewrite_checks(spark, sf):
    ex = spread_out(table(spark, sf, "examples").where("source is not null and target is not null"))
    return ex.select("ex_id", udfs.rewrite_reasons("source", "target", F.lit("text")).alias("reasons"))


@query
def scorer_holdout(spark, sf):
    """Held-out accuracy of the default scorer: fitted on nine tenths of the records by digest, measured on the rest."""
    x = scorer.labelled_clauses(table(spark, sf, "clause_rows"), "id").withColumn("test", F.pmod(F.xxhash64("id"), F.lit(10)) == 0)
    said = scorer.fit_default(x.where("not test")).transform(x.where("test"))
    return said.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy"), F.round(F.avg("label"), 4).alias("share_kept"))


@query
def adaptive_thresholds(spark, sf):
    x = _scores(spark, sf).agg(F.stddev_pop("score").alias("s"))
    return x.select(F.round(scorer.adaptive_threshold(F.col("s")), 6).alias("threshold"))


@query
def request_answers(spark, sf):
    r = _turns(spark, sf).where("text is not null").select(F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")).alias("value"))
    return flows.answers(spread_out(r))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
