"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from __future__ import annotations

from quillspark.functions import grammar as g
from quillspark.operators.evaluate import STOP_WORDS
from quillspark.plans.queries import NOW, PHRASES, PROJECT, SESSION_DAY

NL = "chr(10)"
BODY = f"string_split(case when right(text, 1) = {NL} then left(text, length(text) - 1) else text end, {NL})"
# numbered lines of every non-null text, with the final newline set apart
LINES = f"""
src as (select doc_id, text, case when right(text, 1) = {NL} then {NL} else '' end as tail, {BODY} as l from documents where text is not null),
ln as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from src)"""
REST = """
select d.doc_id, case when d.text is null then null when d.text = '' then '' else r.body || s.tail end as out
from documents d left join src s on s.doc_id = d.doc_id left join r on r.doc_id = d.doc_id"""

_IN, _OUT = "coalesce(in_chars, 0)", "coalesce(out_chars, 0)"
_SUMMARY = f"""
select {{keys}} requests, floor(i * 0.25)::bigint as input_tokens, floor(o * 0.25)::bigint as output_tokens, floor(greatest(0, i - o) * 0.25)::bigint as saved_tokens,
  case when i > 0 then round_even(greatest(0, i - o) / i * 100, 1) else 0 end as saved_pct, units, kept_units,
  case when units > 0 then round_even(kept_units / units * 100, 1) else 0 end as kept_pct, round_even(m, 1) as total_ms,
  case when requests > 0 then round_even(m / requests, 1) else 0 end as avg_ms
from (select {{keys}} count(*) as requests, coalesce(sum({_IN}), 0)::bigint as i, coalesce(sum({_OUT}), 0)::bigint as o, coalesce(sum(coalesce(ms, 0)::decimal(28, 6)), 0)::double as m,
  coalesce(sum(coalesce(units, 0)), 0)::bigint as units, coalesce(sum(coalesce(kept, 0)), 0)::bigint as kept_units from ledger {{where}} {{group}})"""


def _summary(keys: str = "", where: str = "") -> str:
    return _SUMMARY.format(keys=keys + ", " if keys else "", where=where, group=f"group by {keys}" if keys else "")


_NAME = "coalesce(nullif({0}, ''), 'unknown')"
_BY_KEY = "select " + _NAME + " as name, count(*) as requests, sum(" + _IN + ")::bigint as in_chars, sum(" + _OUT + ")::bigint as out_chars from ledger group by 1"
_DAY = f"select strftime(to_timestamp(ts) at time zone 'UTC', '%Y-%m-%d') as day, sum(greatest(0, {_IN} - {_OUT}))::bigint as saved_chars from ledger where ts is not null group by 1"
_HUMAN = "case when v < 1000 then v::bigint::varchar when v < 1e6 then printf('%.1fK', v / 1e3) when v < 1e9 then printf('%.1fM', v / 1e6) when v < 1e12 then printf('%.1fB', v / 1e9) else printf('%.1fT', v / 1e12) end"
_RECENT = f"""select day, saved_chars, level, substr('▁▂▃▄▅▆▇█', level + 1, 1) as bar from (
  select day, saved_chars, case when max(saved_chars) over () > 0 then least(7, floor(saved_chars / max(saved_chars) over () * 7)) else 0 end::int as level from (select * from ({_DAY}) order by day desc limit 14))"""
_ABOVE = ", ".join(f"'{'/'.join(PROJECT.split('/')[:k])}'" for k in range(2, len(PROJECT.split("/")) + 1))

ANSI = r"chr(27) || '\[[0-9;]*m'"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_UNI = f"regexp_replace(text, '(?:{BREAKS})\\z', '')"
UNI_LINES = f"""
src as (select doc_id, text, string_split_regex({_UNI}, '{BREAKS}') as l from documents where text is not null),
ln as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from src)"""
W = r"\p{L}\p{M}\p{N}\p{Pc}"  # RE2's own word class is ASCII


def words_of(flags: str, body: str) -> str:
    """``body`` between word boundaries that know all letters."""
    return f"(?{flags})(?:^|[^{W}])(?:{body})(?:$|[^{W}])"


_LEVELS = f"(?i)(?:^|[^{W}])(FATAL|ERROR|ERR|FAILED|FAIL|CRITICAL|WARNING|WARN|INFO|DEBUG|TRACE)(?:$|[^{W}])"
_SCORE = f"""case when lv in ('FATAL', 'ERROR', 'ERR', 'FAILED', 'FAIL', 'CRITICAL') then 1.0 when lv in ('WARN', 'WARNING') then 0.7 when lv = 'INFO' then 0.3 when lv in ('DEBUG', 'TRACE') then 0.1
  when regexp_matches(line, '(?i)^\\s*(Traceback \\(most recent call last\\)|at .+\\(.+:\\d+:\\d+\\)|File ".+", line \\d+|.*Error:|.*Exception:|.*Failed to)') then 0.8
  when regexp_matches(line, '(?i)^\\s*(?:\\d+\\s+(?:passed|failed|errors?|skipped|warnings?)|=+ .* =+$|total|summary|(?:test|build) result)') then 0.9 else 0.2 end"""
_LOGS = f"""
src as (select doc_id, regexp_replace(text, {ANSI}, '', 'g') as t from documents where text is not null),
arr as (select doc_id, t, string_split(case when right(t, 1) = {NL} then left(t, length(t) - 1) else t end, {NL}) as l from src),
ln as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i, len(l) as n from arr),
lv as (select *, upper(regexp_extract(line, '{_LEVELS}', 1)) as lv from ln),
sc as (select *, {_SCORE} as score from lv)"""
_CLOGS = f"""
hd as (select *, case when regexp_replace(line, '\\s+', '', 'g') = '' then 0 when contains(line, 'Traceback (most recent call last)') then 2 else 1 end as h from sc),
tr as (select *, coalesce(lag(h, 1) over w, 0) as h1, coalesce(lag(h, 2) over w, 0) as h2, coalesce(lag(h, 3) over w, 0) as h3 from hd window w as (partition by doc_id order by i)),
mk as (select *, score >= 0.7 or i <= 2 or i > n - 2 or h = 2 or (h > 0 and (h1 = 2 or (h1 > 0 and (h2 = 2 or (h2 > 0 and h3 = 2))))) as held from tr),
ti as (select *, case when held and score >= 0.8 then 0 when held then 1 when score between 0.2 and 0.79 then 2 else 3 end as tier, trim(regexp_replace(line, '\\d+', 'N', 'g'), ' ' || chr(9) || chr(13)) as k from mk),
rk as (select *, row_number() over (partition by doc_id, case when tier in (1, 2) then k end, tier in (1, 2) order by tier, i) as r from ti),
kp as (select * from rk where tier = 0 or (tier in (1, 2) and r = 1)),
gp as (select *, coalesce(lead(i) over (partition by doc_id order by i), -1) as nx from kp),
r as (select doc_id, string_agg(line || case when i < n and nx <> i + 1 then {NL} || '  ...' else '' end, {NL} order by i) as body from gp group by doc_id),
res as (select a.doc_id, a.t, case when len(a.l) >= 10 and length(r.body || case when right(a.t, 1) = {NL} then {NL} else '' end) < length(a.t) then r.body || case when right(a.t, 1) = {NL} then {NL} else '' end else a.t end as out from arr a left join r on r.doc_id = a.doc_id)"""


def _headed(match: str, key: str, rest: str) -> str:
    return f"""with {LINES},
kd as (select *, case when {match} then {key} end as k from ln),
pv as (select *, lag(k) over (partition by doc_id order by i) as p from kd),
r as (select doc_id, string_agg(case when k is null then line when k is not distinct from p then {rest} else k || {NL} || {rest} end, {NL} order by i) as body from pv group by doc_id)
{REST}"""


_GREP = r"regexp_matches(line, '^[^\n:]+:\d+:.*$')"
_DIR = r"regexp_matches(line, '^[^\n:]*/[^/\n:]*:\d+:')"
_PATH = r"'^((?:\.{0,2}/)?(?:[^/\s:]+/)+)([^/\s:]+)$'"
_CHANGED = "((starts_with(line, '+') or starts_with(line, '-')) and not starts_with(line, '+++') and not starts_with(line, '---'))"
_META = " or ".join(f"starts_with(line, '{p}')" for p in ("diff --git ", "index ", "--- ", "+++ ", "@@ ", "new file mode ", "deleted file mode ", "similarity index ", "rename from ", "rename to "))
_DIFF = f"""{UNI_LINES},
ch as (select *, {_CHANGED} as c from ln),
nr as (select *, bool_or(c) over (partition by doc_id order by i rows between 2 preceding and 2 following) as near, lag(c) over (partition by doc_id order by i) as before from ch),
r as (select doc_id, string_agg(line, {NL} order by i) as body from nr where {_META} or near or (line = '\\ No newline at end of file' and before) group by doc_id),
df as (select distinct doc_id from ln where starts_with(line, 'diff --git '))"""
_FAILURE = words_of("i", "error|failed|failure|fatal|panic|traceback|exception|warn|warning") + "|✗|(?i:FAILED|Segmentation fault)"
_NORM = r"trim(regexp_replace(lower({0}), '[\s\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"
_GROUP = r"regexp_replace(coalesce(id, 'row'), ':[^:]*\z', '')"
_GRAMS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_SWEEP = """
u as (select unnest(units) as u, unnest(labels) as y from clause_rows where len(units) = len(labels)),
s as (select least(0.999, length(u.text) / 100.0) as score, y from u),
t as (select k / 100.0 as threshold from range(1, 100) r(k)),
sw as (select threshold, case when sum(y) > 0 then sum(case when score >= threshold then y else 0 end) / sum(y) else 1.0 end as recall,
  case when count(*) filter (score >= threshold) > 0 then sum(case when score >= threshold then y else 0 end) / count(*) filter (score >= threshold) else 1.0 end as "precision",
  count(*) filter (score >= threshold) / count(*) as retention from t, s group by threshold)"""

_ENTITIES = {
    "block_id": r"blk_-?\d+", "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "node": f"dfs\\.[{W}]+(?:\\$[{W}]+)?", "port": r":\d{4,5}\b", "timestamp": r"\d{6}\s+\d{6}", "url": r"https?://\S+",
    "path": f"(?:/[{W}.-]+){{2,}}", "size": r"(?i)\b\d+(?:\.\d+)?(?:KB|MB|GB|bytes?)\b",
}
_ERR = words_of("i", "FATAL|ERROR|CRITICAL|FAILED|Exception")
CUT = "chr(1)"
_CLAUSES = f"""
src as (select doc_id, string_split(text, {NL}) as l from documents where text is not null),
ln as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from src),
ab as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int as base from ln),
mk as (select *, string_split(regexp_replace(regexp_replace(regexp_replace(line, '([!?;。！？；؟؛]+)', '\\1' || {CUT}, 'g'), '([,،])(\\s)', '\\1' || {CUT} || '\\2', 'g'), '(\\.)(\\s|$)', '\\1' || {CUT} || '\\2', 'g'), {CUT}) as p from ab where line <> ''),
pc as (select doc_id, i, base, unnest(p) as raw, generate_subscripts(p, 1) as k from mk),
po as (select *, base + coalesce(sum(length(raw)) over (partition by doc_id, i order by k rows between unbounded preceding and 1 preceding), 0)::int as pos from pc),
cl as (select doc_id, i, k, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') as clause, pos + length(raw) - length(regexp_replace(raw, '^\\s+', '')) as start_off from po where regexp_replace(raw, '\\s+', '', 'g') <> '')"""


def _status(pattern: str) -> str:
    return pattern.replace(r"\w", f"[{W}]").replace("'", "''")


ORACLES: dict[str, str] = {
    "ledger_summary": _summary(),
    "ledger_by_source": _BY_KEY.format("source"),
    "ledger_by_project": _BY_KEY.format("cwd"),
    "ledger_by_session": _summary("session"),
    "ledger_by_day": _DAY,
    "ledger_saved_on_day": f"select floor(coalesce(sum(greatest(0, {_IN} - {_OUT})), 0) * 0.25)::bigint as saved_tokens from ledger where ts >= epoch(timestamp '{SESSION_DAY}') and ts < epoch(timestamp '{SESSION_DAY}') + 86400",
    "ledger_top_projects": f"select name, requests, v as saved_tokens, {_HUMAN} as saved_text, saved_pct from (select name, requests, floor(greatest(0, in_chars - out_chars) * 0.25)::bigint as v, case when in_chars > 0 then round_even(greatest(0, in_chars - out_chars) / in_chars * 100, 1) else 0 end as saved_pct from ({_BY_KEY.format('cwd')}) order by in_chars desc, name limit 10)",
    "ledger_recent_days": _RECENT,
    "ledger_sparkline": f"select count(*) as days, string_agg(bar, '' order by day) as line, max(saved_chars) as peak_chars from ({_RECENT})",
    "ledger_project_scope": _summary(where=f"where cwd in ({_ABOVE})"),
    "ledger_since_days": _summary(where=f"where ts >= {NOW} - 90 * 86400"),
    "ledger_windows": f"select date_trunc('day', to_timestamp(ts) at time zone 'UTC') as start, {_NAME.format('source')} as source, count(*) as requests, sum(greatest(0, {_IN} - {_OUT}))::bigint as saved_chars from ledger where ts is not null group by 1, 2",
    "strip_ansi": f"select doc_id, regexp_replace(text, {ANSI}, '', 'g') as out from documents",
    "collapse_runs": f"""with {LINES},
g as (select *, i - row_number() over (partition by doc_id, line order by i) as grp from ln),
q as (select doc_id, line, min(i) as i, count(*) as n from g group by doc_id, line, grp),
r as (select doc_id, string_agg(line || case when n > 1 then {NL} || '... (repeated ' || n || ' times)' else '' end, {NL} order by i) as body from q group by doc_id)
{REST}""",
    "search_heading": _headed(_GREP, r"regexp_extract(line, '^([^\n:]+):\d+:', 1)", r"regexp_replace(line, '^[^\n:]+:', '')"),
    "search_dir_heading": _headed(f"{_GREP} and {_DIR}", r"regexp_extract(line, '^([^\n:]*/)[^/\n:]*:\d+:', 1)", r"regexp_replace(line, '^[^\n:]*/', '')"),
    "search_unheading": "select doc_id, text as out from documents where text is not null",
    "path_heading": f"""with a as ({_headed(f"regexp_matches(line, {_PATH})", f"regexp_extract(line, {_PATH}, 1)", f"regexp_extract(line, {_PATH}, 2)")}),
n as (select doc_id, count(*) as n from (select doc_id, unnest({BODY}) as line from documents where text is not null) where regexp_matches(line, {_PATH}) group by doc_id)
select d.doc_id, case when coalesce(n.n, 0) >= 2 then a.out else d.text end as out from documents d join a using (doc_id) left join n using (doc_id)""",
    "diff_strip_index": f"""with {LINES}, r as (select doc_id, coalesce(string_agg(line, {NL} order by i) filter (not regexp_matches(line, '^index [0-9a-fA-F]+\\.\\.[0-9a-fA-F]+( [0-7]+)?$')), '') as body from ln group by doc_id) {REST}""",
    "compact_git_diff": f"with {_DIFF} select d.doc_id, case when df.doc_id is not null then r.body else d.text end as out from documents d left join df using (doc_id) left join r using (doc_id)",
    "compact_logs": f"with {_LOGS}, {_CLOGS} select d.doc_id, res.out from documents d left join res using (doc_id)",
    "log_line_scores": f"with {_LOGS} select doc_id, score::double as score, count(*) as n from sc group by 1, 2",
    "expand_runs": "select true as restored, count(*) as n from documents",
    "routes": f"with {UNI_LINES}, d as (select distinct doc_id from ln where starts_with(line, 'diff --git ')) select case when d.doc_id is not null then 'diff' when length(text) < 10 then 'tiny' when length(text) < 200 then 'short' else 'model' end as route, count(*) as n, sum(length(text))::bigint as chars from src left join d using (doc_id) group by 1",
    "head_tail_trim": f"select doc_id, case when length(text) <= 500 then text else left(text, 300) || {NL} || '…[' || (length(text) - 500) || ' chars trimmed]…' || {NL} || right(text, 200) end as out, ceil(length(text) / 4)::bigint as tokens from documents where text is not null",
    "turn_failures": f"select conv_id, count(*) filter (regexp_matches(text, '{_FAILURE}')) as n_failures, count(*) filter (length(text) >= 300 and not regexp_matches(text, '{_FAILURE}')) as n_considered from conversations where text is not null group by conv_id",
    "conversation_budget": "select conv_id, t as total_tokens, t > 1000 * 0.5 as is_open from (select conv_id, ceil((sum(length(coalesce(text, ''))) + count(*) - 1) / 4)::bigint as t from conversations group by conv_id)",
    "turn_recency": "select conv_id, turn, n as from_end, n <= 2 as is_recent from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as n from (select distinct conv_id, turn from conversations))",
    "eligible_turns": f"""with o as (select * from (select *, row_number() over (partition by conv_id, turn order by received_at) as k from conversations) where k = 1),
b as (select conv_id, ceil((sum(length(coalesce(text, ''))) + count(*) - 1) / 4) > 500 as is_open from o group by conv_id),
r as (select *, row_number() over (partition by conv_id order by turn desc, received_at desc) as n from o)
select conv_id, count(*) filter (n > 2 and is_open and coalesce(length(text) >= 300 and not regexp_matches(text, '{_FAILURE}'), false) and coalesce(lower(trim(role)), '') <> 'system') as n_eligible, count(*) as n_turns from r join b using (conv_id) group by conv_id""",
    "part_routes": "select case when lower(trim(role)) = 'tool' then 'value' else 'text' end as route, count(*) as n from conversations group by 1",
    "exact_duplicates": f"select sha256({_NORM.format('text')}) as fingerprint, min(doc_id) as first_id, count(*) as copies from documents where text is not null group by 1 having count(*) > 1",
    "new_payloads": "select ex_id, id from examples where source is not null and batch_no > 0 and id is not null and id not in (select id from examples where source is not null and batch_no = 0 and id is not null) union all select ex_id, id from examples where source is not null and batch_no > 0 and id is null",
    "first_rows": "select ex_id, id, batch_no from (select *, row_number() over (partition by id order by batch_no, ex_id) as r from examples where id is not null) where r = 1",
    "ngram_overlap": f"""with w as (select doc_id, {_GRAMS.format('text')} as w from documents where text is not null),
g as (select distinct doc_id, array_to_string(w[i:i+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
e as (select {_GRAMS.format('source')} as w from examples where source is not null),
h as (select distinct array_to_string(w[i:i+7], ' ') as g from (select w, unnest(range(1, len(w) - 6)) as i from e where len(w) >= 8))
select doc_id as id, count(*) as n_grams, count(h.g) as n_shared, round(count(h.g) / count(*), 4) as share from g left join h using (g) group by doc_id""",
    "supervision_references": """select row_id, (select count(*) from (select distinct unnest(coalesce(target_unit_ids, [])) as x) where x is not null and not list_contains(coalesce(ids, []), x)) as n_unknown,
(select count(*) from (select distinct unnest(coalesce(fixed, [])) as x) where not list_contains(coalesce(target_unit_ids, []), x)) as n_protected_missing,
(select count(*) from (select distinct unnest(coalesce(target_unit_ids, [])) as x) where x is not null and not list_contains(coalesce(proven, []), x) and not list_contains(coalesce(fixed, []), x)) as n_unproven
from (select row_id, target_unit_ids, list_transform(units, lambda u: u.id) as ids, list_transform(list_filter(units, lambda u: u.protected), lambda u: u.id) as fixed, flatten(list_transform(facts, lambda f: f.evidence_unit_ids)) as proven from msc)""",
    "group_keys": f"select {_GROUP} as group_key, count(*) as n from msc group by 1",
    "hash_split": f"with g as (select distinct {_GROUP} as k from msc), r as (select k, row_number() over (order by sha256('7:' || k)) as n, count(*) over () as t from g) select row_id, n <= greatest(1, round_even(t * 0.1, 0)) as is_validation from msc join r on r.k = {_GROUP}",
    "training_windows": """with m as (select row_id, unnest(units) as u, generate_subscripts(units, 1) - 1 as i, target_unit_ids as w from msc where units is not null and target_unit_ids is not null)
select row_id || ':' || (i // 4) as window_id, count(*) as n_units, count(*) filter (list_contains(w, u.id)) as n_kept from m group by row_id, i // 4""",
    "usable_training_rows": "select language, count(*) as n from clause_rows where len(labels) > 0 and list_sum(labels) / len(labels) <= 0.8 group by language",
    "language_latency": f"""with x as (select {_NAME.format('source')} as source, 1 - out_chars / in_chars as red, ms, units, kept from ledger where ms is not null and in_chars > 0 and out_chars is not null and units > 0 and kept is not null)
select source, count(*) as examples, quantile_cont(red, 0.5) as median_reduction, min(red) as min_reduction, quantile_cont(ms, 0.5) as median_ms, sum(kept) / greatest(1, sum(units)) as protected_recall,
list_sort(list(ms))[greatest(0, round_even(0.95 * count(*), 0)::bigint - 1) + 1] as p95_ms from x group by source""",
    "latency_p95": "select list_sort(list(ms))[least(count(*) - 1, floor(0.95 * count(*))::bigint) + 1] as p from ledger where ms is not null",
    "threshold_sweep": f"with {_SWEEP} select * from sw",
    "chosen_threshold": f"with {_SWEEP} select * from sw order by case when recall >= 0.95 then 0 else 1 end, case when recall >= 0.95 then retention else -recall end, threshold limit 1",
    "repeated_sentences": f"""select ex_id, len(s) <> len(list_distinct(s)) as repeats from (select ex_id, list_transform(list_filter(string_split_regex(target, '[.!?\\n]+'), lambda x: len(regexp_extract_all(x, '[{W}@./:+%-]+')) >= 4), lambda x: {_NORM.format('x')}) as s from examples where target is not null)""",
    "entity_preservation": f"""with {_LOGS}, {_CLOGS},
b as (select d.doc_id, d.text, res.out from documents d join res using (doc_id)),
e as (""" + " union all ".join(f"select doc_id, '{k}' as entity, list_distinct(regexp_extract_all(text, '{p}')) as o, list_distinct(regexp_extract_all(out, '{p}')) as c from b" for k, p in _ENTITIES.items()) + """)
select doc_id, entity, len(o) as original, len(list_intersect(o, c)) as preserved, len(o) - len(list_intersect(o, c)) as lost, round_even(len(list_intersect(o, c)) / greatest(len(o), 1), 3) as ratio from e""",
    "critical_facts": f"""with {_LOGS}, {_CLOGS},
b as (select d.doc_id, string_split_regex(regexp_replace(d.text, '(?:{BREAKS})\\z', ''), '{BREAKS}') as o, string_split_regex(regexp_replace(res.out, '(?:{BREAKS})\\z', ''), '{BREAKS}') as c from documents d join res using (doc_id)),
f as (select doc_id, list_filter(o, lambda x: regexp_matches(x, '{_ERR}')) as o, list_filter(c, lambda x: regexp_matches(x, '{_ERR}')) as c from b),
p as (select *, list_distinct(list_transform(o, lambda x: regexp_replace(trim(x), '\\d+', 'N', 'g'))) as po, list_distinct(list_transform(c, lambda x: regexp_replace(trim(x), '\\d+', 'N', 'g'))) as pc from f)
select doc_id, len(o) as error_lines_original, len(c) as error_lines_compressed, len(po) as patterns_total, len(list_intersect(po, pc)) as patterns_preserved, round_even(len(list_intersect(po, pc)) / greatest(len(po), 1), 3) as preservation_rate from p""",
    "clause_split": f"with {_CLAUSES} select doc_id, row_number() over (partition by doc_id order by i, k) - 1 as pos, clause, start_off, start_off + length(clause) as end_off from cl",
    "checkpoint_status": f"""with {_CLAUSES}, fl as (select doc_id, {", ".join(f"regexp_matches(clause, '{words_of('i', _status(p))}') as is_{k}" for k, p in g.STATUS.items())},
  regexp_matches(clause, '{words_of("i", _status(g.NARRATION))}') as is_narration, regexp_matches(clause, '^[^.!?。！？:：\n]{{1,48}}[:：]$') as is_label,
  (regexp_matches(clause, '^\\.{{2,}}$') or (regexp_matches(clause, '(?i)^(?:collected [0-9]+ items|.*(?:^|[^{W}])PASSED)$') and not regexp_matches(clause, '{words_of("i", _status(g.STATUS["fail"]))}'))) as is_tool_noise from cl)
select doc_id, {", ".join(f"count(*) filter ({f}) as {f}" for f in ("is_done", "is_next", "is_decision", "is_fail", "is_constraint", "is_narration", "is_label", "is_tool_noise"))},
  count(*) filter (not is_tool_noise and (is_done or is_next or is_decision or is_fail or is_constraint)) as keep_status from fl group by doc_id""",
    "tfidf_similarity": f"""with w as (select ex_id, 0 as d, unnest(regexp_extract_all(lower(source), '[{W}]{{2,}}')) as w from examples where source is not null and target is not null
  union all select ex_id, 1, unnest(regexp_extract_all(lower(target), '[{W}]{{2,}}')) from examples where source is not null and target is not null),
t as (select ex_id, w, count(*) filter (d = 0)::double as a, count(*) filter (d = 1)::double as b from w where w not in ({", ".join(repr(x) for x in STOP_WORDS)}) group by 1, 2),
r as (select *, row_number() over (partition by ex_id order by a + b desc, w) as k from t),
v as (select ex_id, a * (ln(3.0 / ((a > 0)::int + (b > 0)::int + 1)) + 1) as a, b * (ln(3.0 / ((a > 0)::int + (b > 0)::int + 1)) + 1) as b from r where k <= 5000)
select ex_id, round(case when sum(a * a) > 0 and sum(b * b) > 0 then sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) else 0 end, 6) as cosine from v group by ex_id""",
    "ledger_one_line": f"""select case when s.requests > 0 then (select {_HUMAN} from (select s.saved_tokens as v)) || ' saved · ' || s.saved_pct || '% · ' || s.requests || ' reqs · today ' || (select {_HUMAN} from (select d.saved_tokens as v)) else 'no data' end as line
from ({_summary()}) s, (select floor(coalesce(sum(greatest(0, {_IN} - {_OUT})), 0) * 0.25)::bigint as saved_tokens from ledger where ts >= epoch(timestamp '{SESSION_DAY}') and ts < epoch(timestamp '{SESSION_DAY}') + 86400) d""",
    "adaptive_thresholds": f"with {_SWEEP} select round(greatest(0.1, least(0.6, 0.28 + greatest(-0.1, least(0.1, stddev_pop(score) * 0.3 - 0.1)))), 6) as threshold from s",
}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::varchar[]"


_PHRASES = " union all ".join(f"select '{l}' as language, {_list(k)} as keep, {_list(c)} as commands, '{n}' as noise" for l, k, c, n in PHRASES)
ORACLES["policy_rows"] = f"""with p as ({_PHRASES}), r as (select *, range as i from p, range(40)),
k as (select *, case when len(commands) > 0 then commands[1 + i % len(commands)] else keep[4] end as command from r)
select 'policy-' || language || '-' || i as id, language, (13 + i % 5)::int as n_units, 9 as n_kept,
  (list_sum(list_transform(keep, lambda x: length(x))) - length(keep[4]) + length(command) + (3 + i % 5) * length(noise) + length(keep[6]) + 12 + i % 5)::int as n_chars from k"""


ORACLES["ledger_sessions"] = """with e as (select session, to_timestamp(ts) as t0, coalesce(in_chars, 0) as c from ledger where ts is not null and session is not null),
m as (select *, case when t0 <= (lag(t0) over w) + to_minutes(30) then 0 else 1 end as fresh from e window w as (partition by session order by t0)),
n as (select *, sum(fresh) over (partition by session order by t0 rows unbounded preceding) as k from m)
select min(t0) as start, max(t0) + to_minutes(30) as "end", session, count(*) as requests, sum(c)::bigint as in_chars from n group by session, k"""

_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"  # white space of all scripts
ORACLES["collapse_spaces"] = f"""with l as (select doc_id, text, string_split_regex({_UNI}, '{BREAKS}') as l from documents),
b as (select doc_id, text, list_transform(l, lambda x: {{'x': x, 'b': regexp_replace(x, '^{_WS}+', '')}}) as l from l),
t as (select doc_id, text, list_transform(l, lambda r: regexp_replace(case when r.b = '' then '' else left(r.x, length(r.x) - length(r.b)) end || regexp_replace(r.b, '{_WS}{{2,}}', ' ', 'g'), '[ \\t]+$', '')) as l from b)
select doc_id, case when text = '' then '' else regexp_replace(array_to_string(l, {NL}), '\\n{{3,}}', {NL} || {NL}, 'g') end as out from t"""
ORACLES["cleanup_text"] = f"""with a as (select doc_id, string_split(regexp_replace(text, '(?m)^[ \\t]*$', '', 'g'), {NL}) as l from documents),
b as (select doc_id, regexp_replace(array_to_string(list_transform(l, lambda x: regexp_extract(x, '^([ \\t]*)', 1) || regexp_replace(regexp_replace(regexp_replace(x, '^[ \\t]*', ''), '[ \\t]+', ' ', 'g'), '{_WS}+$', '')), {NL}), '\\n{{3,}}', {NL} || {NL}, 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '[ \\t]+([,;:!?])', '\\1', 'g'), '[ \\t]+\\.([^A-Za-z_]|$)', '.\\1', 'g') as t from b),
d as (select doc_id, regexp_replace(regexp_replace(t, '([,;])(?:{_WS}*[,;])+', '\\1', 'g'), '(\\A|\\n){_WS}*[,;:]{_WS}*', '\\1', 'g') as t from c)
select doc_id, regexp_replace(t, '\\A{_WS}+|{_WS}+\\z', '', 'g') as out from d"""

ORACLES["source_chunks"] = r"""with recursive c as (
  select doc_id, 0 as k, text as rest from documents where text <> ''
  union all select doc_id, k + 1, substr(rest, cut + 1) from (select *, case when length(rest) <= 1000 then length(rest) when size > 0 then 700 + size else 1000 end as cut from (
    select *, 300 - length(regexp_extract(substr(rest, 701, 300), '[^\n ]*$')) as size from c)) where cut < length(rest))
select doc_id, k::int as k, case when length(rest) <= 1000 then length(rest) when size > 0 then 700 + size else 1000 end::int as n_chars
from (select *, 300 - length(regexp_extract(substr(rest, 701, 300), '[^\n ]*$')) as size from c)"""

# the checks one by one, over unnested rows
ORACLES["supervision_errors"] = r"""with m as (select * from msc where coalesce(source, '') <> ''),
u0 as (select row_id, source, unnest(units) as u, generate_subscripts(units, 1) as i from m),
u1 as (select row_id, i, u.id as id, coalesce(u.protected, false) as fixed, coalesce(u.id is not null and u.start_off is not null and u.end_off is not null and u.text is not null
    and u.role in ('core', 'action', 'constraint', 'evidence', 'mechanism', 'identifier', 'detail', 'noise'), false) as whole,
  coalesce(u.start_off >= 0 and u.start_off < u.end_off and substr(source, u.start_off + 1, u.end_off - u.start_off) = u.text, false) as quoted from u0),
u2 as (select *, coalesce(bool_or(whole and quoted) over (partition by row_id, id order by i rows between unbounded preceding and 1 preceding), false) as again from u1),
known as (select row_id, id, fixed from u2 where whole and quoted and not again),
chosen as (select distinct row_id, t as id from (select row_id, unnest(target_unit_ids) as t from m) where t is not null),
f0 as (select row_id, unnest(facts) as f, generate_subscripts(facts, 1) as i from m),
f1 as (select row_id, i, f.id as id, coalesce(f.central, false) as central, coalesce(f.central, false) or coalesce(f.required, false) as needed, f.evidence_unit_ids as ev,
  coalesce(f.id is not null and f.claim is not null and f.evidence_unit_ids is not null, false) as whole, coalesce(regexp_matches(f.claim, '[^\s]'), false) and len(f.evidence_unit_ids) > 0 as grounded from f0),
e1 as (select distinct row_id, i, unnest(ev) as id from f1),
f2 as (select f1.*, coalesce(e.lost, 0) as lost, coalesce(e.hit, 0) as hit from f1 left join (
  select row_id, i, count(*) filter (known.id is null) as lost, count(*) filter (chosen.id is not null) as hit from e1 left join known using (row_id, id) left join chosen using (row_id, id) group by all) e using (row_id, i)),
f3 as (select *, whole and grounded and len(ev) <= 8 and lost = 0 as sound from f2),
f4 as (select *, coalesce(bool_or(sound) over (partition by row_id, id order by i rows between unbounded preceding and 1 preceding), false) as again from f3),
proven as (select * from f4 where sound and not again),
used as (select distinct p.row_id, e1.id from proven p join e1 using (row_id, i)),
q0 as (select row_id, unnest(verification_questions) as q, generate_subscripts(verification_questions, 1) as k from m),
q1 as (select row_id, k, q.question as question, coalesce(regexp_matches(q.question, '[^\s]'), false) and coalesce(len(q.answer_fact_ids), 0) > 0 as whole, q.answer_fact_ids as a from q0),
q2 as (select row_id, k, list(distinct a.id order by a.id) filter (p.id is null) as lost, bool_or(p.hit = 0) as bare from (select distinct row_id, k, unnest(a) as id from q1) a left join proven p using (row_id, id) group by all),
l as (select row_id, list(id order by id) as ids, 'unknown_target_units:' as code from chosen anti join known using (row_id, id) group by row_id
  union all select row_id, list(id order by id), 'missing_protected_units:' from (select * from known where fixed) anti join chosen using (row_id, id) group by row_id
  union all select row_id, list(id order by id), 'selected_without_fact:' from (select * from chosen anti join used using (row_id, id)) anti join (select * from known where fixed) using (row_id, id) group by row_id)
select row_id, 'source_missing' as error from msc where coalesce(source, '') = ''
union all select row_id, 'central_message_missing' from m where not coalesce(regexp_matches(central_message, '[^\s]'), false)
union all select row_id, case when not whole then 'invalid_unit' when again then 'duplicate_unit:' || id else 'unit_evidence_mismatch:' || id end from u2 where not whole or again or not quoted
union all select row_id, code || '[' || chr(39) || array_to_string(ids, chr(39) || ', ' || chr(39)) || chr(39) || ']' from l
union all select row_id, case when not whole then 'invalid_fact' when not grounded then 'ungrounded_fact:' || id when len(ev) > 8 then 'fact_evidence_not_atomic:' || id when lost > 0 then 'unknown_fact_evidence:' || id
  when again then 'duplicate_fact:' || id else 'required_fact_not_selected:' || id end from f4 where not sound or again or (needed and hit = 0)
union all select row_id, 'central_fact_missing' from m where row_id not in (select row_id from proven where central)
union all select q1.row_id, case when not whole then 'invalid_verification_question' when len(lost) > 0 then 'unknown_question_facts:[' || chr(39) || array_to_string(lost, chr(39) || ', ' || chr(39)) || chr(39) || ']'
  else 'unanswerable_verification_question:' || trim(question) end from q1 left join q2 using (row_id, k) where not whole or len(lost) > 0 or bare"""


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if v}
