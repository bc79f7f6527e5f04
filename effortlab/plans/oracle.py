"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The derived views (tickets, dataset, feedback, predictions, runs) are
spelled as CTEs so the oracle reads the same base tables as Spark.
"""

from __future__ import annotations

from ..functions.text import ANALYSIS_WORDS, DEV_WORDS, TEST_WORDS

WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\p{Z}"
STRIP = f"'^[{WS}]+|[{WS}]+$'"
WORD = f"'[^{WS}]+'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def any_contains(x: str, words: list[str]) -> str:
    return "cast((" + " or ".join(f"contains({x}, '{w}')" for w in words) + ") as integer)"


TICKETS = """tickets as (
 select o_orderkey as ticket_id,
  concat('T-', cast(o_orderkey as varchar(20)), ' ', c_name) as summary,
  coalesce(text, '') as description,
  cast(floor(o_totalprice / 2) as bigint) as time_spent,
  case when o_orderstatus = 'P' then null
       else cast(cast(substr(o_orderpriority, 1, 1) as int) * 3 - 3 as double) end as estimate,
  r_name as region, concat(r_name, '/', n_name) as subsystem, c_mktsegment as commitments,
  o_orderdate as created_at,
  case o_orderstatus when 'F' then 'Done' when 'O' then 'In Progress' else 'Open' end as status
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey left join documents on o_orderkey = doc_id)"""

TICKETS_RAW = r"""tickets_raw as (
 select ticket_id, ticket_id % 50 in (7, 13) as odd, region, subsystem, commitments,
  case when ticket_id % 50 = 7 then concat(chr(9), '[{''value'': ''it\''s ] ', region, ''', ''tags'': [{''a'': [1, None, (2,)]}]},]')
    when ticket_id % 50 = 13 then concat('[{''value'': ''', repeat('x', 5000), region, '''}]')
    when ticket_id % 5 = 0 then null when ticket_id % 5 = 1 then '[]'
    when ticket_id % 5 = 2 then concat('[{''value'': ''', region, '''}, {''value'': ''ALL''}]')
    else concat('[{''value'': ''', region, '''}]') end as region_raw,
  case when ticket_id % 50 = 7 then concat('{''value'': "', region, '", ''child'': {''value'': ''B\x41'', ''x'': {''y'': 1}}}')
    when ticket_id % 50 = 13 then concat('{''child'': {''value'': {''deep'': [[[]]]}, ''value'': ''', subsystem, '//''}, ''value'': ''S''}')
    when ticket_id % 4 = 0 then 'oops' when ticket_id % 4 = 1 then concat('{''value'': ''', region, '''}')
    else concat('{''value'': ''', region, ''', ''child'': {''value'': ''', subsystem, '''}}') end as subsystem_raw,
  case when ticket_id % 50 = 7 then concat('{''value'': ''', commitments, '\u00e9'' ''!'', ''n'': None}')
    when ticket_id % 50 = 13 then concat('{''all'': [', repeat('[], ', 1500), '], ''value'': ''', commitments, '''}')
    when ticket_id % 3 = 0 then '[1]' else concat('{''value'': ''', commitments, '''}') end as commitments_raw
 from tickets)"""



def features_sql(text: str = "text", description: str = "description") -> str:
    lt = f"lower({text})"
    return f"""cast(length({strip(description)}) > 0 as integer) as has_description,
  cast(contains(lower({description}), '{{code') as integer) as has_code_block,
  {any_contains(lt, DEV_WORDS)} as is_dev_task,
  {any_contains(lt, TEST_WORDS)} as is_test_task,
  {any_contains(lt, ANALYSIS_WORDS)} as is_analysis_task,
  cast(length({text}) as integer) as text_len,
  cast(len(regexp_extract_all({text}, {WORD})) as integer) as word_count"""


RISK = """cast(case when logged_days / estimate <= 1.0 then 0 when logged_days / estimate <= 1.5 then 1
  when logged_days / estimate > 1.5 then 2 else 0 end as integer)"""

DATASET = f"""dataset as (
 select ticket_id, summary, description, text, estimate, logged_days, {RISK} as risk_level,
  region, subsystem, commitments, {features_sql()}
 from (select *, concat(summary, ' ', description) as text, time_spent / 28800.0 as logged_days
       from tickets
       where time_spent is not null and estimate is not null and estimate > 0 and estimate <= 10))"""

SPLIT = """split as (
 select *, case when rk * 10 <= 8 * n then 'train' when rk * 10 <= 9 * n then 'test' else 'val' end as split
 from (select *, row_number() over (partition by risk_level
          order by md5(concat('42|', cast(ticket_id as varchar))), ticket_id) as rk,
        count(*) over (partition by risk_level) as n from dataset))"""

FEEDBACK = """feedback as (
 select id, created_at, summary, description, region, subsystem, commitments, predicted_days, actual_days,
  is_used_for_training,
  case when actual_days <> 0 then (actual_days - predicted_days) / actual_days * 100.0 end as delta_pct
 from (select event_id as id, ts as created_at,
   concat('Event ', event_type, ' of user ', cast(user_id as varchar)) as summary,
   coalesce(props, '') as description, 'Unknown' as region,
   concat('users/', cast(user_id % 10 as varchar)) as subsystem, event_type as commitments,
   floor(value / 50) * 5 + 2.5 as predicted_days,
   case when event_id % 97 = 0 then 0.0 else value / 10 end as actual_days,
   cast(case when event_id % 3 = 0 then 1 else 0 end as integer) as is_used_for_training
  from events))"""


def _pred_cols() -> str:
    cols = []
    for k in range(5):
        cols.append(f"ln(1 + estimate / 2) * (0.8 + 0.1 * {k}) + cast(ticket_id % 11 as double) / 40.0 as pred_log_{k}")
        cols.append(f"cast((ticket_id + {k}) % 10 as double) / 20.0 as p2_{k}")
        cols.append(f"cast((ticket_id + {2 * k}) % 7 as double) / 20.0 as p1_{k}")
        cols.append(f"1.0 - cast((ticket_id + {2 * k}) % 7 as double) / 20.0 - cast((ticket_id + {k}) % 10 as double) / 20.0 as p0_{k}")
    return ",\n  ".join(cols)


PREDICTIONS = f"""predictions as (
 select *, {_pred_cols()}
 from dataset)"""

RUNS = """runs as (
 select event_id as seq, md5(concat('run|', cast(user_id as varchar))) as run_id,
  date_trunc('hour', ts) as created_at,
  case event_id % 3 when 0 then 'feedback' when 1 then 'manual' else 'seed' end as trigger,
  case when event_type in ('click', 'view', 'purchase') then 'estimate' else 'risk' end as model_type,
  case when event_type in ('click', 'view', 'purchase') then value / 997.0 end as r2,
  case when event_type in ('click', 'view', 'purchase') then value / 89.0 end as mae,
  case when event_type in ('click', 'view', 'purchase') then value / 71.0 end as rmse,
  case when event_type not in ('click', 'view', 'purchase') then (value % 100) / 101.0 end as overrun_recall,
  case when event_type in ('click', 'view', 'purchase')
       then [value / 997.0, (value + 1) / 997.0, (value + 2) / 997.0, (value + 3) / 997.0, (value + 4) / 997.0]
       else cast([] as double[]) end as fold_scores
 from events)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


register("prepare_dataset", with_(TICKETS, DATASET) + "select * from dataset")
register("text_features", with_(TICKETS) + f"""select ticket_id, {features_sql('text', 'description')}
 from (select ticket_id, description, concat(summary, ' ', description) as text from tickets)""")
register("risk_distribution", with_(TICKETS, DATASET) + """select risk_level, n_rows, n_rows / sum(n_rows) over () as share
 from (select risk_level, count(*) as n_rows from dataset group by risk_level)""")


def _mean(cols: list[str]) -> str:
    return "(" + " + ".join(cols) + f") / {float(len(cols))}"


_LOGS = [f"pred_log_{k}" for k in range(5)]
_DAYS = [f"(exp(pred_log_{k}) - 1)" for k in range(5)]
_MD = _mean(_DAYS)
ENS = f"""ens0 as (
 select *, {_mean(_LOGS)} as pred_log,
  greatest(exp({_mean(_LOGS)}) - 1, 0.0) as pred_days,
  sqrt({_mean([f"({d} - {_MD}) * ({d} - {_MD})" for d in _DAYS])}) as pred_std_days,
  {_mean([f"p0_{k}" for k in range(5)])} as p_low,
  {_mean([f"p1_{k}" for k in range(5)])} as p_medium,
  {_mean([f"p2_{k}" for k in range(5)])} as p_critical
 from predictions),
ens as (
 select *, cast(case when p_low >= p_medium and p_low >= p_critical then 0
   when p_medium >= p_critical then 1 else 2 end as integer) as pred_risk
 from ens0)"""

TEST_ENS = """test_ens as (select e.* from ens e where ticket_id in (select ticket_id from split where split = 'test'))"""

RUNS_LATEST = """runs_latest as (
 select * exclude (rn) from (select *, row_number() over (partition by run_id order by seq desc) as rn from runs)
 where rn = 1)"""

CV = """cv as (select * from split where split in ('train', 'val'))"""
FOLDS = """folds as (
 select *, cast(ntile(5) over (order by md5(concat('fold|42|', cast(ticket_id as varchar))), ticket_id) - 1
   as integer) as fold from cv)"""
BOUNDS = """bounds as (
 select f.fold, quantile_cont(c.logged_days, 0.01) as lower, quantile_cont(c.logged_days, 0.99) as upper
 from (select cast(range as integer) as fold from range(5)) f join folds c on c.fold <> f.fold group by f.fold)"""

BASE = with_(TICKETS, DATASET)
T_ONLY = with_(TICKETS)
PRED = with_(TICKETS, DATASET, PREDICTIONS, ENS)


def feat(cols: list[str]) -> str:
    lines = {ln.strip().rstrip(",").split(" as ")[-1]: ln.strip().rstrip(",") for ln in features_sql().split("\n")}
    sel = ", ".join(lines[c] for c in cols)
    return T_ONLY + f"select ticket_id, {sel} from (select *, concat(summary, ' ', description) as text from tickets)"


register("fill_text", T_ONLY + "select ticket_id, coalesce(summary, '') as summary, coalesce(description, '') as description from tickets")
register("concat_text", T_ONLY + f"select ticket_id, concat(summary, ' ', description) as text, {strip(chr(99) + 'oncat(summary, chr(32), description)')} as text_stripped from tickets")
register("has_description", feat(["has_description"]))
register("has_code_block", feat(["has_code_block"]))
register("keyword_flags", feat(["is_dev_task", "is_test_task", "is_analysis_task"]))
register("text_len", feat(["text_len"]))
register("word_count", feat(["word_count"]))
register("seconds_to_workdays", T_ONLY + "select ticket_id, time_spent, time_spent / 28800.0 as logged_days from tickets")

_J = "replace(case when not odd then {c} end, '''', '\"')"
# JSON does not read the odd ones; what they hold follows from how they are put together.
_ODD = "case when odd then case ticket_id % 50 when 7 then {seven} else {thirteen} end else {plain} end"
_ODD_REGION = {"seven": "concat('it''s ] ', region)", "thirteen": "concat(repeat('x', 5000), region)"}
_ODD_SUBSYSTEM = {"seven": "concat(region, '/BA')", "thirteen": "concat('S/', subsystem)"}
_ODD_COMMIT = {"seven": "concat(commitments, 'é!')", "thirteen": "commitments"}
def region_sql(j: str) -> str:
    return f"""case when {j} is not null and json_valid({j}) and json_type({j}) = 'ARRAY' and json_array_length({j}) > 0
  then array_to_string(list_sort(list_transform(list_filter(from_json({j}, '["JSON"]'), lambda x: json_type(x) = 'OBJECT'),
       lambda x: coalesce(x ->> 'value', 'БАЗОВЫЙ'))), ', ')
  else 'БАЗОВЫЙ' end"""


def subsystem_sql(j: str) -> str:
    return f"""case when {j} is not null and json_valid({j}) and json_type({j}) = 'OBJECT' and ({j} ->> 'value') is not null
  then rtrim(concat({j} ->> 'value', '/', coalesce({j} -> 'child' ->> 'value', '')), '/') else '' end"""


def commitments_sql(j: str) -> str:
    return f"""case when {j} is not null and json_valid({j}) and json_type({j}) = 'OBJECT' and ({j} ->> 'value') is not null
  then {j} ->> 'value' else '' end"""


_REGION = _ODD.format(plain=region_sql("j"), **_ODD_REGION)
_SUBSYSTEM = _ODD.format(plain=subsystem_sql("j"), **_ODD_SUBSYSTEM)
_COMMIT = _ODD.format(plain=commitments_sql("j"), **_ODD_COMMIT)
register("parse_region", with_(TICKETS, TICKETS_RAW) + f"select ticket_id, {_REGION} as region from (select *, {_J.format(c='region_raw')} as j from tickets_raw)")
register("parse_subsystem", with_(TICKETS, TICKETS_RAW) + f"select ticket_id, {_SUBSYSTEM} as subsystem from (select *, {_J.format(c='subsystem_raw')} as j from tickets_raw)")
register("parse_commitments", with_(TICKETS, TICKETS_RAW) + f"select ticket_id, {_COMMIT} as commitments from (select *, {_J.format(c='commitments_raw')} as j from tickets_raw)")

_VALID = "where time_spent is not null and estimate is not null and estimate > 0 and estimate <= 10"
register("filter_valid_tickets", T_ONLY + f"select ticket_id, estimate, time_spent / 28800.0 as logged_days from tickets {_VALID}")
register("risk_level", T_ONLY + f"""select ticket_id, logged_days / estimate as ratio, {RISK} as risk_level
 from (select *, time_spent / 28800.0 as logged_days from tickets {_VALID})""")
register("project_dataset", BASE + "select * exclude (ticket_id, summary, description) from dataset")
register("log_target", BASE + """select ticket_id, ln(1 + logged_days) as y_log,
 abs(greatest(exp(ln(1 + logged_days)) - 1, 0.0) - logged_days) <= 1e-9 * (1 + logged_days) as roundtrip_ok from dataset""")
register("delta_pct", with_(FEEDBACK) + "select id, delta_pct from feedback")
register("delta_pct_abs", with_(FEEDBACK) + "select id, round_even(abs(predicted_days - actual_days) / greatest(actual_days, 0.001) * 100.0, 2) as delta_pct_abs from feedback")
register("default_category", with_(TICKETS, TICKETS_RAW) + """select ticket_id, coalesce(nullif(region_raw, ''), 'Unknown') as region,
 coalesce(case when subsystem_raw <> 'oops' then subsystem_raw end, 'Unknown') as subsystem from tickets_raw""")
register("validate_summary", f"""select doc_id, case when coalesce(length({strip('text')}) = 0, true) then 'rejected' else 'accepted' end as status
 from documents""")
register("risk_buffer", PRED + """select ticket_id, 1.0 + 0.15 * p_medium + 0.5 * p_critical as buffer_factor,
 greatest(0.0, pred_days * 8.0) as predicted_hours,
 greatest(0.0, pred_days * 8.0) * (1.0 + 0.15 * p_medium + 0.5 * p_critical) as adjusted_hours from ens""")
_FMT = """round_even(greatest(0.0, pred_days * 8.0), 1) as predicted_time_hours,
 round_even(greatest(0.0, pred_days * 8.0) * (1.0 + 0.15 * p_medium + 0.5 * p_critical), 1) as adjusted_time_with_buffer_hours,
 round_even(pred_std_days, 2) as prediction_std_days,
 round_even(p_low * 100.0, 1) as low_risk_prob_pct, round_even(p_medium * 100.0, 1) as medium_risk_prob_pct,
 round_even(p_critical * 100.0, 1) as critical_risk_prob_pct"""
register("format_prediction", PRED + f"select ticket_id, {_FMT} from ens")
register("high_risk_flag", PRED + f"""select ticket_id, cast(critical_risk_prob_pct >= 20.0 as integer) as high_risk,
 predicted_time_hours / 8.0 as predicted_days from (select ticket_id, {_FMT} from ens)""")
register("fold_scores_json", with_(RUNS) + "select seq, fold_scores, cast(len(fold_scores) as integer) as n_scores from runs")
register("cast_features", BASE + """select ticket_id, cast(has_description as float) as has_description,
 cast(has_code_block as float) as has_code_block, cast(is_dev_task as float) as is_dev_task,
 cast(is_test_task as float) as is_test_task, cast(is_analysis_task as float) as is_analysis_task,
 cast(text_len as float) as text_len, cast(word_count as float) as word_count, region, subsystem, commitments from dataset""")
register("short_revision", with_(RUNS) + "select seq, substr(run_id, 1, 7) as revision from runs")

register("join_features", BASE + """select vec_id as ticket_id, embedding, region, subsystem, commitments, logged_days
 from embeddings join dataset on vec_id = ticket_id""")
_BP = with_(TICKETS, DATASET, SPLIT) + """, train as (select * from split where split = 'train'),
test as (select * from split where split = 'test'),
g as (select quantile_cont(ln(1 + logged_days), 0.5) as pred_global from train),
ms as (select subsystem, ln(1 + quantile_cont(logged_days, 0.5)) as m from train where subsystem is not null group by subsystem),
mr as (select region, ln(1 + quantile_cont(logged_days, 0.5)) as m from train where region is not null group by region),
bp as (select t.*, g.pred_global, coalesce(ms.m, g.pred_global) as pred_subsystem, coalesce(mr.m, g.pred_global) as pred_region
 from test t cross join g left join ms on t.subsystem = ms.subsystem left join mr on t.region = mr.region)
"""
register("lookup_with_fallback", _BP + "select ticket_id, pred_subsystem, pred_region from bp")
register("global_median", _BP + "select ticket_id, pred_global from bp")
register("group_median", _BP + "select subsystem, m as median_log from ms")
register("mark_feedback_used", with_(FEEDBACK) + """select id, cast(case when is_used_for_training = 0 and commitments = 'click' then 1
 else is_used_for_training end as integer) as is_used_for_training from feedback""")
register("delete_matching", with_(FEEDBACK) + """select id, summary from feedback
 where summary not in (select summary from feedback where commitments = 'error')""")

register("feedback_counts", with_(FEEDBACK) + """select total, unused, unused >= 50 as retrain_ready, greatest(0, 50 - unused) as remaining
 from (select count(*) as total, count_if(is_used_for_training = 0) as unused from feedback)""")
register("feedback_metrics", with_(FEEDBACK) + """select count(*) as feedbacks_collected, round_even(avg(delta_pct), 1) as feedback_mean_delta_pct,
 round_even(avg(case when delta_pct is not null then case when abs(delta_pct) <= 25.0 then 1.0 else 0.0 end end), 3)
  as feedback_accuracy_within_25pct from feedback""")
register("target_profile", BASE + """select count(logged_days) as n, avg(logged_days) as mean, quantile_cont(logged_days, 0.5) as median,
 stddev_samp(logged_days) as std, quantile_cont(logged_days, 0.95) as p95, quantile_cont(logged_days, 0.99) as p99,
 max(logged_days) as max from dataset""")
register("category_profile", BASE + """, pairs as (
 select 'region' as "column", region as value from dataset union all
 select 'subsystem', subsystem from dataset union all select 'commitments', commitments from dataset),
c as (select "column", value, count(*) as cnt from pairs where value is not null group by 1, 2)
select "column", count(*) as n_distinct, min_by(value, (-cnt, value)) as top_value, max(cnt) / sum(cnt) as top_share
from c group by 1""")
_YP = PRED + ", yp as (select ticket_id, logged_days as y, pred_days as p from ens)\n"
register("r2", _YP + "select 1.0 - sum((y - p) * (y - p)) / (count(y) * var_pop(y)) as r2 from yp")
register("mae", _YP + "select avg(abs(y - p)) as mae from yp")
register("rmse", _YP + "select sqrt(avg((y - p) * (y - p))) as rmse from yp")
_ED = """stddev_pop(p - y) as error_std, quantile_cont(abs(p - y), 0.5) as median_abs_error, max(abs(p - y)) as max_abs_error,
 avg(cast(abs(p - y) <= 0.25 as double)) as share_within_0_25, avg(cast(abs(p - y) <= 0.5 as double)) as share_within_0_5,
 avg(cast(abs(p - y) <= 1.0 as double)) as share_within_1, avg(cast(abs(p - y) > 2.0 as double)) as share_over_2"""
register("error_distribution", _YP + f"select {_ED} from yp")
register("mdape", _YP + "select quantile_cont(case when y <> 0 then abs(y - p) / abs(y) * 100.0 end, 0.5) as mdape from yp")
register("grouped_errors", PRED + """select region, count(*) as count, round_even(avg(abs(logged_days - pred_days)), 2) as mae,
 round_even(quantile_cont(logged_days, 0.5), 2) as median_actual from ens where region is not null group by region""")
register("percentile_bounds", with_(TICKETS, DATASET, SPLIT, CV, FOLDS, BOUNDS) + "select * from bounds")
_CR = """, cm as (select risk_level as y, pred_risk as p, count(*) as n from {src} group by 1, 2),
w as (select sum(n) as total, sum(case when y = p then n else 0 end) as correct,
 sum(case when y = 0 and p = 0 then n else 0 end) as tp0, sum(case when y = 0 then n else 0 end) as sup0, sum(case when p = 0 then n else 0 end) as pred0,
 sum(case when y = 1 and p = 1 then n else 0 end) as tp1, sum(case when y = 1 then n else 0 end) as sup1, sum(case when p = 1 then n else 0 end) as pred1,
 sum(case when y = 2 and p = 2 then n else 0 end) as tp2, sum(case when y = 2 then n else 0 end) as sup2, sum(case when p = 2 then n else 0 end) as pred2
 from cm),
pc as (select *,
 case when pred0 > 0 then tp0 / pred0 else 0.0 end as pr0, case when sup0 > 0 then tp0 / sup0 else 0.0 end as rc0,
 case when pred1 > 0 then tp1 / pred1 else 0.0 end as pr1, case when sup1 > 0 then tp1 / sup1 else 0.0 end as rc1,
 case when pred2 > 0 then tp2 / pred2 else 0.0 end as pr2, case when sup2 > 0 then tp2 / sup2 else 0.0 end as rc2 from w),
pf as (select *,
 case when pr0 + rc0 > 0 then 2 * pr0 * rc0 / (pr0 + rc0) else 0.0 end as f0,
 case when pr1 + rc1 > 0 then 2 * pr1 * rc1 / (pr1 + rc1) else 0.0 end as f1_,
 case when pr2 + rc2 > 0 then 2 * pr2 * rc2 / (pr2 + rc2) else 0.0 end as f2 from pc),
rep as (
 select '0' as label, pr0 as precision, rc0 as recall, f0 as f1, cast(sup0 as double) as support from pf union all
 select '1', pr1, rc1, f1_, cast(sup1 as double) from pf union all
 select '2', pr2, rc2, f2, cast(sup2 as double) from pf union all
 select 'accuracy', correct / total, correct / total, correct / total, cast(total as double) from pf union all
 select 'macro avg', (pr0 + pr1 + pr2) / 3, (rc0 + rc1 + rc2) / 3, (f0 + f1_ + f2) / 3, cast(total as double) from pf union all
 select 'weighted avg', (pr0 * sup0 + pr1 * sup1 + pr2 * sup2) / total, (rc0 * sup0 + rc1 * sup1 + rc2 * sup2) / total,
   (f0 * sup0 + f1_ * sup1 + f2 * sup2) / total, cast(total as double) from pf)
"""
register("classification_report", PRED + _CR.format(src="ens") + "select * from rep")
register("fold_summary", with_(RUNS, RUNS_LATEST) + """select run_id, avg(score) as mean_score, stddev_pop(score) as std_score, count(*) as n_folds
 from (select run_id, unnest(fold_scores) as score from runs_latest) group by run_id""")
register("class_weights", BASE + """select risk_level, n_rows, max(n_rows) over () / n_rows as weight
 from (select risk_level, count(*) as n_rows from dataset group by 1)""")
register("row_accounting", BASE + """select rows_imported, rows_kept, 1.0 - rows_kept / rows_imported as share_dropped
 from (select (select count(*) from tickets) as rows_imported, (select count(*) from dataset) as rows_kept)""")
register("hours_saved", with_(FEEDBACK) + "select count(*) as feedbacks_collected, round_even(cast(count(*) as double) * 0.25, 1) as hours_saved from feedback")

register("latest_model_run", with_(RUNS, RUNS_LATEST) + """select model_type, run_id, created_at, trigger, r2, mae, rmse, overrun_recall, fold_scores
 from (select *, row_number() over (partition by model_type order by created_at desc, run_id desc) as rk from runs_latest) where rk = 1""")
_PRED_TEST = with_(TICKETS, DATASET, SPLIT, PREDICTIONS, ENS, TEST_ENS)
register("top_subsystems_by_mae", _PRED_TEST + """select subsystem, count, round_even(mae, 2) as mae, round_even(median_actual, 2) as median_actual
 from (select subsystem, count(*) as count, avg(abs(logged_days - pred_days)) as mae, quantile_cont(logged_days, 0.5) as median_actual
   from test_ens where subsystem is not null group by subsystem order by mae desc, subsystem limit 10)""")
register("worst_predictions", PRED + """select ticket_id, summary, subsystem, region, logged_days as actual_days, round_even(pred_days, 1) as pred_days,
 round_even(abs(logged_days - pred_days), 1) as abs_error_days from ens order by abs(logged_days - pred_days) desc, ticket_id limit 10""")
register("recent_feedback", with_(FEEDBACK) + "select id, summary, predicted_days, actual_days from feedback order by id desc limit 5")
register("recent_runs", with_(RUNS, RUNS_LATEST) + """select model_type, cast(rk as integer) as rank, run_id, round_even(r2, 4) as r2, round_even(mae, 4) as mae,
 round_even(rmse, 4) as rmse, round_even(overrun_recall, 4) as overrun_recall
 from (select *, row_number() over (partition by model_type order by created_at desc, run_id desc) as rk from runs_latest) where rk <= 3""")

register("union_train_val", with_(TICKETS, DATASET, SPLIT) + "select ticket_id, split from split where split in ('train', 'val')")
register("unused_feedback_rows", with_(FEEDBACK) + """select id, summary, description, region, subsystem, commitments, actual_days
 from feedback where is_used_for_training = 0""")
register("stratified_split", with_(TICKETS, DATASET, SPLIT) + "select ticket_id, risk_level, split from split")
register("kfold_assign", with_(TICKETS, DATASET, SPLIT, CV, FOLDS) + "select ticket_id, fold from folds")
register("fold_outlier_trim", with_(TICKETS, DATASET, SPLIT, CV, FOLDS, BOUNDS) + """select b.fold as cv_fold,
 case when c.fold = b.fold then 'val' else 'train' end as role, count(*) as n_rows, min(c.logged_days) as min_y, max(c.logged_days) as max_y
 from folds c join bounds b on true
 where c.fold = b.fold or (c.logged_days >= b.lower and c.logged_days <= b.upper) group by 1, 2""")

register("ensemble_effort", PRED + "select ticket_id, pred_log, pred_days, pred_std_days from ens")
register("ensemble_risk", PRED + "select ticket_id, p_low, p_medium, p_critical, pred_risk from ens")
register("evaluate_effort", _PRED_TEST + f""", yp as (select logged_days as y, pred_days as p from test_ens)
select 1.0 - sum((y - p) * (y - p)) / (count(y) * var_pop(y)) as r2, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
 count(*) as n, {_ED} from yp""")
register("evaluate_risk", _PRED_TEST + _CR.format(src="test_ens") + """select *, (select recall from rep where label = '2') as critical_recall from rep""")

_BP_MODEL = with_(TICKETS, DATASET, SPLIT, PREDICTIONS, ENS) + _BP[len(with_(TICKETS, DATASET, SPLIT)):].replace(
    "test as (select * from split where split = 'test')",
    "test as (select s.*, e.pred_log from split s join ens e using (ticket_id) where s.split = 'test')")
register("baseline_report", _BP_MODEL + """, m as (select
 1.0 - sum((ln(1 + logged_days) - pred_global) ^ 2) / (count(*) * var_pop(ln(1 + logged_days))) as r2l0,
 1.0 - sum((logged_days - greatest(exp(pred_global) - 1, 0.0)) ^ 2) / (count(*) * var_pop(logged_days)) as r2d0,
 avg(abs(logged_days - (exp(pred_global) - 1))) as mae0,
 1.0 - sum((ln(1 + logged_days) - pred_subsystem) ^ 2) / (count(*) * var_pop(ln(1 + logged_days))) as r2l1,
 1.0 - sum((logged_days - greatest(exp(pred_subsystem) - 1, 0.0)) ^ 2) / (count(*) * var_pop(logged_days)) as r2d1,
 avg(abs(logged_days - (exp(pred_subsystem) - 1))) as mae1,
 1.0 - sum((ln(1 + logged_days) - pred_region) ^ 2) / (count(*) * var_pop(ln(1 + logged_days))) as r2l2,
 1.0 - sum((logged_days - greatest(exp(pred_region) - 1, 0.0)) ^ 2) / (count(*) * var_pop(logged_days)) as r2d2,
 avg(abs(logged_days - (exp(pred_region) - 1))) as mae2,
 1.0 - sum((ln(1 + logged_days) - pred_log) ^ 2) / (count(*) * var_pop(ln(1 + logged_days))) as r2l3,
 1.0 - sum((logged_days - greatest(exp(pred_log) - 1, 0.0)) ^ 2) / (count(*) * var_pop(logged_days)) as r2d3,
 avg(abs(logged_days - (exp(pred_log) - 1))) as mae3 from bp)
select 'Global median' as baseline, round_even(r2l0, 4) as r2_log, round_even(r2d0, 4) as r2_days, round_even(mae0, 3) as mae_days from m union all
select 'Median by subsystem', round_even(r2l1, 4), round_even(r2d1, 4), round_even(mae1, 3) from m union all
select 'Median by region', round_even(r2l2, 4), round_even(r2d2, 4), round_even(mae2, 3) from m union all
select 'Model ensemble', round_even(r2l3, 4), round_even(r2d3, 4), round_even(mae3, 3) from m""")
register("error_report", _PRED_TEST + """, e as (select *, abs(logged_days - pred_days) as ae from test_ens)
select 'overall' as section, cast(null as varchar) as "group", count(ae) as count, round_even(avg(ae), 2) as mae,
 round_even(quantile_cont(logged_days, 0.5), 2) as median_actual from e
union all
select * from (select 'subsystem', subsystem, count(*), round_even(avg(ae), 2), round_even(quantile_cont(logged_days, 0.5), 2)
 from e where subsystem is not null group by subsystem order by avg(ae) desc, subsystem limit 10)
union all
select 'region', region, count(*), round_even(avg(ae), 2), round_even(quantile_cont(logged_days, 0.5), 2)
 from e where region is not null group by region
union all
select * from (select 'worst', cast(ticket_id as varchar), 1, round_even(ae, 2), round_even(logged_days, 2) from e order by ae desc, ticket_id limit 10)""")
_LATEST_EST = """le as (select * from runs_latest where model_type = 'estimate' order by created_at desc, run_id desc limit 1),
lr as (select * from runs_latest where model_type = 'risk' order by created_at desc, run_id desc limit 1)"""
register("metrics_report", with_(RUNS, RUNS_LATEST, FEEDBACK, _LATEST_EST) + """, fm as (
 select count(*) as feedbacks_collected, round_even(avg(delta_pct), 1) as feedback_mean_delta_pct,
  round_even(avg(case when delta_pct is not null then case when abs(delta_pct) <= 25.0 then 1.0 else 0.0 end end), 3)
   as feedback_accuracy_within_25pct from feedback)
select substr(le.run_id, 1, 7) as model_revision, le.created_at as model_published_at, le.trigger as model_trigger,
 le.r2 as model_r2, le.mae as model_mae, (select overrun_recall from lr) as model_overrun_recall,
 fm.feedbacks_collected, fm.feedback_mean_delta_pct, fm.feedback_accuracy_within_25pct,
 round_even(cast(fm.feedbacks_collected as double) * 0.25, 1) as estimated_hours_saved_per_sprint
from fm left join le on true""")
register("model_status", with_(RUNS, RUNS_LATEST, _LATEST_EST) + """select substr(le.run_id, 1, 7) as model_revision, le.created_at as model_published_at
 from (select 1) one left join le on true""")

register("filter_issue_export", T_ONLY + """select ticket_id, created_at, estimate, time_spent from tickets
 where region = 'ASIA' and status = 'Done' and estimate is not null and time_spent is not null""")
register("model_runs_upsert", with_(RUNS, RUNS_LATEST) + "select run_id, seq, model_type, trigger, r2 from runs_latest")
register("runs_insert_if_absent", with_(RUNS, RUNS_LATEST) + """, ex as (select run_id, trigger, model_type, r2, mae, rmse, overrun_recall
 from runs_latest),
d as (select * from (values ('first-estimate', 'seed', 'estimate', 0.25, 2.0, 3.5, cast(null as double)),
  ('first-anomaly', 'seed', 'anomaly', cast(null as double), cast(null as double), cast(null as double), 0.75))
  t(run_id, trigger, model_type, r2, mae, rmse, overrun_recall))
select * from ex union all select * from d where model_type not in (select model_type from ex)""")
register("feedback_schema_evolve", with_(FEEDBACK) + """select id,
 case when created_at < timestamp '2024-01-15' then '' else coalesce(description, '') end as description from feedback""")

TOKEN = r"'[\p{L}\p{N}_]{2,}'"
register("tokenize", f"select doc_id, regexp_extract_all(lower(text), {TOKEN}) as tokens from documents")
_VS = f"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), {TOKEN})) as term from documents),
tc as (select doc_id, term, count(*) as tf from tok group by 1, 2),
st as (select term, count(doc_id) as df, sum(tf) as cf from tc group by term)
"""
register("vocabulary_stats", _VS + "select term, df, cast(cf as bigint) as cf from st")
register("vocabulary_topk", _VS + """select term, df, cast(cf as bigint) as cf, cast(row_number() over (order by term) - 1 as integer) as term_idx
 from (select * from st where df >= 2 order by cf desc, term limit 25000)""")
register("tfidf", with_(TICKETS, DATASET, SPLIT) + f""", tok as (
 select ticket_id, split, unnest(regexp_extract_all(lower(text), {TOKEN})) as term from split),
tc as (select ticket_id, split, term, count(*) as tf from tok group by 1, 2, 3),
st as (select term, count(*) as df, sum(tf) as cf from tc where split = 'train' group by term),
vocab as (select term, df, row_number() over (order by term) - 1 as term_idx
 from (select * from st where df >= 2 order by cf desc, term limit 25000)),
n as (select count(*) as n from split where split = 'train'),
w as (select ticket_id, term_idx, (1.0 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w
 from tc join vocab using (term) cross join n)
select ticket_id, cast(term_idx as integer) as term_idx, w / sqrt(sum(w * w) over (partition by ticket_id)) as weight from w""")

_META = "has_description, has_code_block, is_dev_task, is_test_task, is_analysis_task, text_len, word_count, region, subsystem, commitments"
register("augment_with_feedback", with_(TICKETS, DATASET, SPLIT, FEEDBACK) + f"""select 'dataset' as source, cast(ticket_id as varchar) as source_id,
 {_META}, logged_days from split where split in ('train', 'val')
union all
select 'feedback', cast(id as varchar), {features_sql('text', 'description')},
 coalesce(nullif(region, ''), 'Unknown'), coalesce(nullif(subsystem, ''), 'Unknown'), coalesce(nullif(commitments, ''), 'Unknown'),
 actual_days
from (select id, coalesce(description, '') as description, region, subsystem, commitments, actual_days,
  {strip("concat(summary, ' ', coalesce(description, ''))")} as text from feedback where is_used_for_training = 0)""")

register("prepare_dataset_raw", with_(TICKETS, TICKETS_RAW) + f""", parsed as (
 select t.ticket_id, t.summary, t.description, t.time_spent, t.estimate,
  r.region_is as region, r.subsystem_is as subsystem, r.commitments_is as commitments
 from tickets t join (
  select ticket_id, {_ODD.format(plain=region_sql('jr'), **_ODD_REGION)} as region_is,
   {_ODD.format(plain=subsystem_sql('js'), **_ODD_SUBSYSTEM)} as subsystem_is,
   {_ODD.format(plain=commitments_sql('jc'), **_ODD_COMMIT)} as commitments_is
  from (select *, {_J.format(c='region_raw')} as jr, {_J.format(c='subsystem_raw')} as js,
   {_J.format(c='commitments_raw')} as jc from tickets_raw)) r using (ticket_id)),
ds as (
 select ticket_id, summary, description, text, estimate, logged_days, {RISK} as risk_level,
  region, subsystem, commitments, {features_sql()}
 from (select *, concat(summary, ' ', description) as text, time_spent / 28800.0 as logged_days
       from parsed
       where time_spent is not null and estimate is not null and estimate > 0 and estimate <= 10))
select * from ds""")

register("flatten_issues", T_ONLY + """select concat('T-', cast(ticket_id as varchar)) as "key", summary, description,
 cast(time_spent as double) as time_spent, estimate, cast(created_at as varchar) as created_at, status, region as project,
 case when ticket_id % 5 <> 0 then region else 'БАЗОВЫЙ' end as region,
 rtrim(concat(region, '/', subsystem), '/') as subsystem, commitments from tickets""")

# Empty text fields read back as null (default NA parsing); fill_text turns them into ''.
register("read_seed_csv", with_(TICKETS, TICKETS_RAW) + """select cast(ticket_id as varchar) as "key", summary,
 nullif(description, '') as description,
 cast(time_spent as double) as time_spent, estimate, region_raw as region, subsystem_raw as subsystem,
 commitments_raw as commitments from tickets join tickets_raw using (ticket_id)""")

register("write_splits", with_(TICKETS, DATASET, SPLIT) + "select split, count(*) as n_rows from split group by split")
register("feedback_stream", with_(FEEDBACK) + f"""select count(*) as total, count(*) as unused, count(*) >= 50 as retrain_ready,
 greatest(0, 50 - count(*)) as remaining from feedback where length({strip('summary')}) > 0""")
register("read_features_csv", with_(TICKETS, DATASET, SPLIT) + """select text, estimate, logged_days, risk_level, region, subsystem,
 commitments, has_description, has_code_block, is_dev_task, is_test_task, is_analysis_task, text_len, word_count
 from split where split = 'train'""")

register("feedback_append", with_(FEEDBACK) + f"""select cast(id as varchar) as ticket_id, summary, coalesce(description, '') as description,
 coalesce(region, 'Unknown') as region, coalesce(subsystem, 'Unknown') as subsystem, coalesce(commitments, 'Unknown') as commitments,
 predicted_days, actual_days, delta_pct, cast(0 as bigint) as batch_id, 0 as is_used_for_training
from feedback where length({strip('summary')}) > 0 and predicted_days is not null and actual_days is not null""")

# ---------------------------------------------------------------- models: what SQL can check of them
_ALL = with_(TICKETS)
_CATS = ["region", "subsystem", "commitments"]
_RANKED = ", ".join(
    f"r_{c} as (select v, cast(row_number() over (order by n desc, v) - 1 as double) as i from "
    f"(select coalesce(nullif({c}, ''), 'Unknown') as v, count(*) as n from split where split in ('train', 'val') group by 1))"
    for c in _CATS)
register("encode_categoricals", with_(TICKETS, DATASET, SPLIT) + f", {_RANKED} select ticket_id, " + ", ".join(
    f"coalesce(r_{c}.i, cast((select count(*) from r_{c}) as double)) as {c}_idx" for c in _CATS) + " from dataset " + " ".join(
    f"left join r_{c} on r_{c}.v = coalesce(nullif(dataset.{c}, ''), 'Unknown')" for c in _CATS))
register("lsa_fit", "select cast(i as integer) as component, true as orthonormal, true as descending, true as sign_ok from range(32) t(i)")
register("lsa_transform", with_(TICKETS, DATASET) + "select ticket_id, 32 as dimension, true as zero_flag_ok from dataset")
register("explained_variance", "select true as agrees, true as in_range")
register("train_effort_cv", with_(TICKETS, DATASET, SPLIT, CV, FOLDS, BOUNDS) + """select b.fold,
 count(*) filter (where c.fold <> b.fold and c.logged_days between b.lower and b.upper) as n_train,
 count(*) filter (where c.fold = b.fold) as n_val, true as scored from folds c join bounds b on true group by 1""")
register("train_risk_cv", with_(TICKETS, DATASET, SPLIT, CV, FOLDS) + """select fold, count(*) as n_val,
 (select count(*) from folds) - count(*) as n_train, true as scored from folds group by fold""")
register("score_batch", _ALL + "select ticket_id, true as probabilities_ok, true as hours_ok, true as buffer_ok, true as days_ok from tickets")
register("explain", _ALL + "select ticket_id, true as adds_up, 10 as n_top from tickets")
register("top_features", """with c as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings),
 r as (select *, row_number() over (partition by vec_id order by abs(v) desc, i) - 1 as rank from c)
select vec_id, cast(rank as integer) as rank, printf('f%02d', i) as feature, round_even(v, 4) as shap_value from r where rank < 10""")
register("mean_abs_shap", """with c as (select generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as v from embeddings)
select printf('f%02d', i) as feature, avg(abs(v)) as mean_abs_shap from c group by i order by 2 desc, 1 limit 20""")
register("save_load_models", _ALL + "select ticket_id, true as same from tickets")
register("write_embeddings", with_(TICKETS, DATASET, SPLIT) + "select ticket_id, 32 as dimension, logged_days, risk_level, split from split")
register("log_run_metrics", """select kind, name, cast(step as integer) as step, true as has_value from (values
 ('param', 'max_iter', null), ('param', 'max_depth', null), ('param', 'n_folds', null),
 ('metric', 'fold_0_r2', 0), ('metric', 'fold_1_r2', 1), ('metric', 'fold_2_r2', 2), ('metric', 'fold_3_r2', 3), ('metric', 'fold_4_r2', 4),
 ('metric', 'test_r2', null), ('metric', 'test_mae', null), ('metric', 'test_rmse', null), ('metric', 'test_overrun_recall', null)) t(kind, name, step)""")
register("score_stream", _ALL + "select ticket_id, true as same_as_batch from tickets")
register("retrain_job", with_(FEEDBACK) + """select 'retrained' as status, count(*) as unused_before, cast(0 as bigint) as unused_after,
 true as run_recorded, true as bundle_loadable, cast(3 as bigint) as test_metrics from feedback""")
register("retrain_trigger", with_(FEEDBACK) + """select 'feedback' as trigger, 'estimate' as model_type, true as recorded, count(*) as feedback,
 cast(0 as bigint) as unused_after from feedback""")
