"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bin_slack, content_scores, grouped_split, history_dedup, pair_defects, source_mix, split_overlap, token_budget, token_sizes
from quillspark.operators.spread import spread_out
from quillspark.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    ex = table(spark, sf, "examples").select("ex_id", "batch_no", "source")
    out = history_dedup.deduplicate_batches(ex, "batch_no", "ex_id", "source")
    return out.select(F.col("kept_id").alias("kept_ex_id"), F.col("dup_id").alias("dup_ex_id"))


def _msc_overlaps(spark: SparkSession, sf: str):
    msc = table(spark, sf, "msc").select("row_id", "split", "corpus", "source")
    is_eval = F.coalesce(F.col("split").isin("validation", "test"), F.lit(False))
    is_train = F.coalesce(F.col("split") == "train", F.lit(False))
    return msc, split_overlap.overlaps(msc, "row_id", "split", "source", is_train, is_eval)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    _, found = _msc_overlaps(spark, sf)
    return split_overlap.overlap_pairs(*found)


def p2_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    msc, found = _msc_overlaps(spark, sf)
    return split_overlap.overlap_report(msc, *found, "row_id", "split", "corpus")


SPLIT_WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    msc = table(spark, sf, "msc").select("row_id", "id", "source")
    groups = grouped_split.components(msc, "row_id", "id", "source")
    return groups.where("id <> group_id").select(F.col("group_id").alias("group_row_id"), F.col("id").alias("row_id"))


def p3_new_split(spark: SparkSession, sf: str) -> DataFrame:
    msc = table(spark, sf, "msc").select("row_id", "id", "source")
    groups = grouped_split.components(msc, "row_id", "id", "source")
    return grouped_split.assign_splits(groups, SPLIT_WEIGHTS).select(F.col("id").alias("row_id"), F.col("group_id").alias("group_row_id"), "new_split")


def p3_split_report(spark: SparkSession, sf: str) -> DataFrame:
    msc = table(spark, sf, "msc").select("row_id", "id", "source")
    groups = grouped_split.components(msc, "row_id", "id", "source")
    return grouped_split.split_report(grouped_split.assign_splits(groups, SPLIT_WEIGHTS), SPLIT_WEIGHTS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    ex = table(spark, sf, "examples").select("ex_id", "source", "target")
    return pair_defects.pair_defects(ex, "ex_id", "source", "target").withColumnRenamed("id", "ex_id")


def p4_shortened(spark: SparkSession, sf: str) -> DataFrame:
    ex = table(spark, sf, "examples").select("ex_id", "target")
    return pair_defects.shortened_responses(ex, "ex_id", "target").select(F.col("id").alias("ex_id"), F.col("full_id").alias("full_ex_id"))


def p4_length_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return pair_defects.length_spikes(table(spark, sf, "examples").select("target"), "target")


TOKENIZERS = "/opt/tokenizers"


def _token_counts(spark: SparkSession, sf: str, tokenizers: str) -> tuple[DataFrame, list[str]]:
    msc = table(spark, sf, "msc").select("row_id", "source", "corpus", "language", "domain", "loaded_at")
    counter = token_budget.longest_match_counter(spark, token_budget.piece_vocabulary(os.path.join(tokenizers, "piece_bpe_32k.model")))
    slices = {"corpus": token_budget.named(F.col("corpus")), "language": token_budget.clean_language(F.col("language")), "domain": token_budget.named(F.col("domain"))}
    return token_budget.token_counts(msc, counter, "row_id", "source", "loaded_at", slices), list(slices)


def p5_record_tokens(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_budget.arrivals(_token_counts(spark, sf, tokenizers)[0]).withColumnRenamed("id", "row_id")


def p5_token_budget(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_budget.budget(*_token_counts(spark, sf, tokenizers))


def p5_usable(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Records and usable records per slice, the part of the budget that needs no tokenizer to check."""
    return p5_token_budget(spark, sf, tokenizers).select("corpus", "language", "domain", "n_records", "n_usable")


def p5_calibration(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    msc = table(spark, sf, "msc").select("source", "language")
    return token_budget.calibration(msc, "source", token_budget.clean_language(F.col("language")), os.path.join(tokenizers, "piece_bpe_32k.model"))


def _sizer(spark: SparkSession, tokenizers: str):
    from public_tokenizers import PATTERN

    return token_sizes.token_sizer(spark, os.path.join(tokenizers, "byte_bpe_multi_50k.tiktoken"), PATTERN)


def _packed(spark: SparkSession, sf: str, tokenizers: str) -> DataFrame:
    docs = spread_out(table(spark, sf, "documents").select("doc_id", "text"))
    items = docs.select(F.col("doc_id").alias("id"), _sizer(spark, tokenizers)(F.col("text")).alias("tokens"))
    return bin_slack.pack(items, table(spark, sf, "context_windows"))


def p6_pack(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return _packed(spark, sf, tokenizers).withColumnRenamed("id", "doc_id")


def p6_fill_report(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return bin_slack.fill_report(_packed(spark, sf, tokenizers), table(spark, sf, "context_windows"))


def p6_check(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per window: the texts that were placed, containers over capacity, texts cut though they would fit and gaps between pieces."""
    return bin_slack.violations(_packed(spark, sf, tokenizers), table(spark, sf, "context_windows"))


def _mixed(spark: SparkSession, sf: str, tokenizers: str) -> tuple[DataFrame, DataFrame]:
    docs = spread_out(table(spark, sf, "documents").select("doc_id", "source", "text"))
    targets = table(spark, sf, "mix_targets")
    items = source_mix.usable(docs, targets, _sizer(spark, tokenizers), "doc_id", "text", "source")
    return source_mix.mix(items, targets)


def p7_mix(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return _mixed(spark, sf, tokenizers)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return _mixed(spark, sf, tokenizers)[1]


def p7_check(spark: SparkSession, sf: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per wanted source: chosen rows of another source, rows repeated too often, texts chosen in two rows."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return source_mix.violations(p7_mix(spark, sf, tokenizers), docs, table(spark, sf, "mix_targets"), "doc_id")


def _scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return docs, content_scores.content_scores(docs, table(spark, sf, "watch_terms"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    _, scores = _scores(spark, sf)
    return scores.where(F.col("score") >= content_scores.THRESHOLD).select(F.col("id").alias("doc_id"), "category")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)[1].withColumnRenamed("id", "doc_id")


def p8_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    docs, scores = _scores(spark, sf)
    return content_scores.source_rates(docs, scores, "doc_id", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_overlap_report": p2_overlap_report,
        "p3_found": p3_found,
        "p3_new_split": p3_new_split,
        "p3_split_report": p3_split_report,
        "p4_found": p4_found,
        "p4_shortened": p4_shortened,
        "p4_length_spikes": p4_length_spikes,
        "p5_record_tokens": p5_record_tokens,
        "p5_token_budget": p5_token_budget,
        "p5_usable": p5_usable,
        "p5_calibration": p5_calibration,
        "p6_pack": p6_pack,
        "p6_fill_report": p6_fill_report,
        "p6_check": p6_check,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_check": p7_check,
        "p8_found": p8_found,
        "p8_scores": p8_scores,
        "p8_source_rates": p8_source_rates,
    }


# letters of full width, by their fixed distance from the plain ones
_WIDE, _PLAIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_FOLD = f"regexp_replace(strip_accents(replace(lower(translate(source, '{_WIDE}', '{_PLAIN}')), 'ß', 'ss')), '[\\p{{Cf}}\\p{{Mn}}]', '', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with recursive w as (select ex_id, batch_no, unnest(regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}]+')) as x from examples where source is not null),
e as (select ex_id, batch_no, x, row_number() over (partition by ex_id, x) as k, count(*) over (partition by ex_id) as n from w),
p as (select a.ex_id as a, b.ex_id as b, b.batch_no as t from e a join e b on a.x = b.x and a.k = b.k and (a.batch_no, a.ex_id) < (b.batch_no, b.ex_id) and a.n * 8 >= b.n * 7 and b.n * 8 >= a.n * 7
  group by a.ex_id, b.ex_id, b.batch_no, a.n, b.n having count(*) * 8 >= 7 * greatest(a.n, b.n)),
o as (select b, list(a) as near, row_number() over (order by t, b) as k from p group by b, t),
s as (select 0::bigint as k, []::bigint[] as gone union all select o.k, case when len(list_filter(o.near, lambda x: not list_contains(s.gone, x))) > 0 then list_append(s.gone, o.b) else s.gone end from s join o on o.k = s.k + 1),
g as (select unnest(gone) as id from s where k = (select max(k) from s))
select min(a) as kept_ex_id, b as dup_ex_id from p where b in (from g) and a not in (from g) group by b""",
        "p2_found": f"""with t as (select row_id, split, regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}]', '', 'g') as x from msc where source is not null and split in ('train', 'validation', 'test')),
e as (select distinct x from t where split <> 'train' and x <> ''), r as (select distinct x from t where split = 'train' and x <> ''),
l as (select e.x as a, r.x as b from e join r on abs(length(e.x) - length(r.x)) <= greatest(length(e.x), length(r.x)) // 8
  where case when e.x = r.x then true else levenshtein(e.x, r.x) <= greatest(length(e.x), length(r.x)) // 8 end)
select least(v.row_id, w.row_id) as row_id_a, greatest(v.row_id, w.row_id) as row_id_b from l join t v on v.x = l.a and v.split <> 'train' join t w on w.x = l.b and w.split = 'train'""",
        "p4_shortened": """with t as (select ex_id, regexp_replace(lower(trim(regexp_replace(target, '\\s+', ' ', 'g'))), '[.…\\s]+$', '') as x from examples where target is not null),
o as (select x, lead(x) over (order by x) as y, lead(i) over (order by x) as i from (select x, min(ex_id) as i from t where x <> '' group by x))
select t.ex_id, o.i as full_ex_id from t join o on t.x = o.x and starts_with(o.y, o.x)""",
        "p5_usable": """with m as (select row_id, source, loaded_at, coalesce(nullif(trim(corpus), ''), 'unknown') as corpus, coalesce(nullif(trim(domain), ''), 'unknown') as domain,
  regexp_extract(lower(trim(language)), '^([a-z]*)', 1) as l from msc),
c as (select *, case l when 'eng' then 'en' when 'por' then 'pt' when 'spa' then 'es' when 'deu' then 'de' when 'jp' then 'ja' when 'cn' then 'zh' when 'und' then 'unknown' when '' then 'unknown' else coalesce(l, 'unknown') end as language from m),
r as (select *, regexp_matches(source, '[^\\s]') and row_number() over (partition by regexp_matches(source, '[^\\s]'), trim(source) order by coalesce(loaded_at, timestamptz '9999-01-01'), row_id) = 1 as usable from c)
select corpus, language, domain, count(*) as n_records, count(*) filter (usable) as n_usable from r group by all""",
        "p6_check": "select window_name, (select count(*) from documents where regexp_matches(text, '[^\\s]')) as n_placed, 0::bigint as n_overfull, 0::bigint as n_needless_cuts, 0::bigint as n_gaps from context_windows",
        "p7_check": "select distinct source, 0::bigint as n_wrong_source, 0::bigint as n_too_often, 0::bigint as n_same_text from mix_targets",
    }
