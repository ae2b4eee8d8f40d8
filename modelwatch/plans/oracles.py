"""The registered queries as plain SQL on the same tables, to check the Spark results against.

Pieces that several queries need are CTE texts. The forest has no text here.
"""

from __future__ import annotations

from .. import fixed_values as fv


def h(key: str, seed: str, slots: int = 1000) -> str:
    return f"(('0x' || substr(md5(cast({key} as varchar) || '{seed}'), 1, 8))::BIGINT % {slots})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(x: str) -> str:
    return f"(round(({x})::double + 1e-10::double, 6) + 0.0)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(*columns: str) -> str:
    return "[" + ", ".join(q(c) for c in columns) + "]"


EV = """ev as (select event_id, event_id as ingest_seq, event_type as scope_id, user_id as entity_id, ts, value,
  cast(json_extract_string(props, '$.k') as double) as k, (value > 50)::int as true_label,
  (cast(json_extract_string(props, '$.k') as double) > 50)::int as prediction from events)"""


def scope_alerts(rows: str) -> str:
    return f"""alerts as (select 'alert-' || scope_id as alert_id, scope_id, '1-URGENT' as model_name,
  'accuracy' as alert_metric, avg((prediction = true_label)::int::double) filter (where ts >= timestamp '2024-01-20') as alert_value,
  timestamp '2024-01-20' as alert_ts, timestamp '2024-01-01' as b0, timestamp '2024-01-15' as b1,
  timestamp '2024-01-16' as a0, timestamp '2024-01-30' as a1 from {rows} group by scope_id)"""


def sliced(rows: str, ts: str = "ts") -> str:
    return f"""sl as (select * from (select r.*, a.alert_id, r.{ts} between a.b0 and a.b1 as in_base,
  r.{ts} between a.a0 and a.a1 as in_target from {rows} r join alerts a using (scope_id)) where in_base or in_target)"""


def long(features: list[str]) -> str:
    parts = " union all ".join(f"select alert_id, {q(f)} as feature_name, {f}::double as v, in_base, in_target from sl"
                               for f in features)
    return f"long as (select * from ({parts}) where v is not null and not isnan(v))"


SERIES = """case when lam < 0.2 then 1.0 else greatest(0.0, least(1.0, 2.0 * list_sum(list_transform(range(1, 101),
  lambda k: (case when k % 2 = 1 then 1.0 else -1.0 end)::double * exp(-2.0::double * k * k * lam * lam))))) end"""

#: The null distribution by walking the orders of the pooled sample: i of the first t values are from sample one; mass that reaches the bound stops.
EXACT = """start as (select alert_id, feature_name, n1, n2, round(d * n1 * n2)::bigint as bound from d1 where status = 'ok'),
walk as (select *, 0 as t, 0 as i, 1.0::double as mass, bound <= 0 as absorbed from start
  union all
  select alert_id, feature_name, n1, n2, bound, t + 1, i + s, sum(mass * (case s when 1 then (n1 - i)::double / (n1 + n2 - t)
    else 1 - (n1 - i)::double / (n1 + n2 - t) end)), abs((i + s) * n2 - (t + 1 - i - s) * n1) >= bound
  from walk cross join (select unnest([0, 1]) as s) where not absorbed and t < n1 + n2 and (s = 0 or i < n1) and (s = 1 or t - i < n2) group by all),
px as (select alert_id, feature_name, least(1.0, sum(mass) filter (where absorbed)) as p from walk group by all),
"""


def drift(features: list[str], requested: list[str] | None = None, p: str = "asymptotic") -> str:
    """CTEs from ``sl`` to ``drift`` (one row per alert and feature)."""
    every = requested or features
    missing = [f for f in every if f not in features]
    status = "case when least(n1, n2) < 10 then 'insufficient' else 'ok' end"
    if missing:
        status = f"case when feature_name in ({', '.join(q(f) for f in missing)}) then 'missing_feature' else {status} end"
    lam = "d * sqrt(n1::double * n2 / nullif(n1 + n2, 0))"
    if p == "corrected":
        lam = "d * sqrt(ne) + 1.0::double / (6.0::double * sqrt(ne)) + (d * sqrt(ne) - 1.0::double) / (4.0::double * ne)"
    return f"""{long(features)},
cnt as (select alert_id, feature_name, v, count(*) filter (where in_base) as cb, count(*) filter (where in_target) as ct
  from long group by all),
tot as (select alert_id, feature_name, sum(cb)::double as nb, sum(ct)::double as nt from cnt group by all),
ecdf as (select c.alert_id, c.feature_name, abs((sum(cb) over w) / nullif(nb, 0) - (sum(ct) over w) / nullif(nt, 0)) as d
  from cnt c join tot t on c.alert_id = t.alert_id and c.feature_name = t.feature_name
  window w as (partition by c.alert_id, c.feature_name order by c.v)),
ks as (select alert_id, feature_name, max(d) as d from ecdf group by all),
st as (select alert_id, feature_name, count(*) filter (where in_base) as c1, count(*) filter (where in_target) as c2,
  avg(v) filter (where in_base) as m1, avg(v) filter (where in_target) as m2,
  stddev_pop(v) filter (where in_base) as s1, stddev_pop(v) filter (where in_target) as s2 from long group by all),
pairs as (select alert_id, scope_id, f.feature_name, f.pos from alerts,
  (select unnest({names(*every)}) as feature_name, unnest(range({len(every)})) as pos) f),
d0 as (select p.alert_id, p.scope_id, p.feature_name, p.pos, coalesce(c1, 0) as n1, coalesce(c2, 0) as n2, m1, m2, s1, s2, d
  from pairs p left join st using (alert_id, feature_name) left join ks using (alert_id, feature_name)),
dn as (select *, {status} as status, greatest(round(n1::double * n2 / nullif(n1 + n2, 0)), 1.0) as ne from d0),
d1 as (select *, {lam} as lam from dn),
{EXACT if p == "exact" else ""}d2 as (select d1.*, {"px.p" if p == "exact" else SERIES} as p from d1 {"left join px using (alert_id, feature_name)" if p == "exact" else ""}),
drift as (select alert_id, scope_id, feature_name, pos, status, n1 as baseline_count, n2 as target_count,
  case when status = 'ok' then m1 end as baseline_mean, case when status = 'ok' then m2 end as target_mean,
  case when status = 'ok' then s1 end as baseline_std, case when status = 'ok' then s2 end as target_std,
  case when status = 'ok' then d end as ks_stat, case when status = 'ok' then p end as p_value,
  coalesce(status = 'ok' and p < 0.05, false) as is_drifted from d2)"""


DRIFT_SELECT = f"""select alert_id, feature_name, status, baseline_count, target_count, {r6('baseline_mean')} as baseline_mean,
  {r6('target_mean')} as target_mean, {r6('baseline_std')} as baseline_std, {r6('target_std')} as target_std,
  {r6('ks_stat')} as ks_stat, {r6('p_value')} as p_value, is_drifted from drift"""


def label_shift(rows: str, threshold: float) -> str:
    return f"""lb as (select a.alert_id, count(*) filter (where ts between a0 and alert_ts - interval 1 day) as n1,
  count(*) filter (where ts between alert_ts and a1) as n2,
  avg(true_label::double) filter (where ts between a0 and alert_ts - interval 1 day) as m1,
  avg(true_label::double) filter (where ts between alert_ts and a1) as m2
  from alerts a join {rows} r using (scope_id) where true_label is not null group by a.alert_id),
lshift as (select a.alert_id, a.scope_id, case when coalesce(n1, 0) + coalesce(n2, 0) = 0 then 'empty'
  when least(n1, n2) < 10 then 'insufficient' else 'ok' end as status, coalesce(n1, 0) as baseline_count,
  coalesce(n2, 0) as target_count, case when least(n1, n2) >= 10 then m1 end as baseline_mean,
  case when least(n1, n2) >= 10 then m2 end as target_mean, case when least(n1, n2) >= 10 then m1 - m2 end as drift_delta,
  coalesce(least(n1, n2) >= 10 and m1 - m2 >= {threshold}, false) as is_drifted from alerts a left join lb using (alert_id))"""


def freshness(rows: str, view: str, threshold: float) -> str:
    return f"""lags as (select s.scope_id, s.ts as event_ts, (epoch_us(s.ts) - epoch_us(v.ts)) / 86400000000.0::double as lag
  from {rows} s asof left join {view} v on s.scope_id = v.scope_id and s.entity_id = v.entity_id and s.ts >= v.ts),
fr as (select a.alert_id, count(*) as log_count, count(lag) as matched_count, avg(lag) as mean_lag, max(lag) as max_lag,
  avg((lag > {threshold})::int::double) as share from lags join alerts a using (scope_id)
  where event_ts between a0 and a1 group by a.alert_id),
fresh as (select a.alert_id, a.scope_id, case when coalesce(log_count, 0) = 0
  or a.scope_id not in (select scope_id from {view}) then 'empty' when matched_count < 10 then 'insufficient' else 'ok' end as status,
  coalesce(log_count, 0) as log_count, coalesce(matched_count, 0) as matched_count,
  case when matched_count >= 10 then mean_lag end as mean_lag_days, case when matched_count >= 10 then max_lag end as max_lag_days,
  case when matched_count >= 10 then share end as share_over_threshold,
  coalesce(matched_count >= 10 and mean_lag > {threshold}, false) as is_stale from alerts a left join fr using (alert_id))"""


SEGMENT = """sv as (select e.* exclude (scope_id), c.c_mktsegment as scope_id from ev e join customer c on e.entity_id = c.c_custkey
  where e.scope_id <> 'purchase'),
vw as (select e.* exclude (scope_id), c.c_mktsegment as scope_id from ev e join customer c on e.entity_id = c.c_custkey
  where e.scope_id = 'purchase')"""

VERSIONS = """vs as (select c_mktsegment as scope_id, o_orderpriority as model_name, year(o_orderdate) - 1994 as version,
  avg((o_orderstatus = 'F')::int::double) as accuracy, avg((o_orderstatus = 'O')::int::double) as open_share,
  avg(o_totalprice) as price, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o,
  count(*) filter (where o_orderstatus = 'P') as p from orders join customer on o_custkey = c_custkey group by all),
ver as (select scope_id, model_name, version, scope_id || '/' || model_name || '/' || version as run_id,
  case when f >= o and f >= p then 'F' when o >= p then 'O' else 'P' end as modal_status,
  case when version > 6 then '1' end as seed, accuracy, price, case when version <= 6 then open_share end as open_share from vs),
two as (select *, row_number() over (partition by scope_id, model_name order by version desc) as version_rank from ver
  qualify version_rank <= 2),
heads as (select scope_id, model_name, max(version) filter (where version_rank = 1) as latest_version,
  max(version) filter (where version_rank = 2) as previous_version, max(run_id) filter (where version_rank = 1) as latest_run_id
  from two group by all),
params as (select * from (select scope_id, model_name, 'modal_status' as key, max(modal_status) filter (where version_rank = 2) as previous,
  max(modal_status) filter (where version_rank = 1) as latest from two group by all
  union all select scope_id, model_name, 'seed', max(seed) filter (where version_rank = 2), max(seed) filter (where version_rank = 1)
  from two group by all) where previous is distinct from latest),
mets as (select * from (select scope_id, model_name, 'accuracy' as key, max(accuracy) filter (where version_rank = 2) as previous,
  max(accuracy) filter (where version_rank = 1) as latest from two group by all
  union all select scope_id, model_name, 'price', max(price) filter (where version_rank = 2), max(price) filter (where version_rank = 1)
  from two group by all
  union all select scope_id, model_name, 'open_share', max(open_share) filter (where version_rank = 2),
  max(open_share) filter (where version_rank = 1) from two group by all) where previous is not null or latest is not null),
counts as (select scope_id, model_name, count(distinct version) as version_count from ver group by all)"""

CUSTOMER_VERSIONS = VERSIONS.replace("c_mktsegment as scope_id", "o_custkey::varchar as scope_id").replace(
    "from orders join customer on o_custkey = c_custkey", "from orders")

COMMITS = f"""cm as (select case regexp_extract(url, 'example\\.[a-z]+/([a-z]+)/', 1) when 'en' then 'AUTOMOBILE'
  when 'fr' then 'BUILDING' when 'de' then 'FURNITURE' when 'es' then 'MACHINERY' end as scope_id,
  cast(page_id as varchar) as commit_hash, url, html,
  timestamp '2024-01-01' + to_minutes({h('page_id', 'commit', 43200)}) as committed_at, 'change page ' || page_id as message from pages),
cw as (select a.alert_id, a.scope_id, c.* exclude (scope_id), 'Commit by author on ' || strftime(committed_at, '%Y-%m-%d %H:%M:%S')
  || ': ' || message as summary from cm c join alerts a using (scope_id)
  where committed_at between alert_ts - interval 1 day and alert_ts + interval 1 day and url like '%example.com%')"""


def causes(bug: str, skew: str) -> str:
    """CTEs from ``evidence`` and ``alerts`` to ``causes``."""
    confidence = " ".join(f"when {q(c)} then {v}" for c, v in fv.CONFIDENCE.items())
    return f"""fl as (select alert_id, bool_or(t = 'git_commit') as cm_, bool_or(t = 'feature_drift') as dr_,
  bool_or(t = 'feature_drift' and feature_name = '{bug}') as bug_, bool_or((t = 'feature_drift' and feature_name = '{skew}')
  or t = 'serving_skew') as skew_, bool_or(t = 'feature_staleness') as st_, bool_or(t = 'label_drift') as lb_,
  min(score) filter (where t = 'model_registry_diff') as acc_ from (select evidence_type as t, * from evidence) group by alert_id),
c0 as (select a.*, case when coalesce(cm_ and bug_, false) then 'pipeline_bug' when coalesce(st_, false) then 'stale_feature'
  when coalesce(acc_ < -0.05, false) then 'bad_model_deploy' when coalesce(lb_, false) then 'label_shift'
  when coalesce(skew_, false) then 'serving_skew' when coalesce(dr_, false) then 'feature_drift' else 'control' end as cause
  from alerts a left join fl using (alert_id)),
causes as (select *, (case cause {confidence} end)::double as confidence,
  array_to_string(list_filter({names(*fv.CAUSES)}, lambda x: x <> cause), ',') as ruled_out from c0)"""


HYPOTHESES = "hyp as (select alert_id, scope_id, cause, h.* from causes, (values " + ", ".join(
    f"({i}, {q(hid)}, {q(c)}, {q(t)})" for i, (hid, c, t) in enumerate(fv.HYPOTHESES)
) + ") h(position, hypothesis_id, stands_for, text))"


def segment_evidence() -> str:
    return f"""with {EV}, {SEGMENT}, {scope_alerts('sv')}, {sliced('vw')}, {drift(['value', 'k'])},
{VERSIONS}, {COMMITS}, {label_shift('sv', 0.02)}, {freshness('sv', 'vw', 2.5)},
rep as (select h.*, c.version_count, (select max(latest - previous) from mets m where m.key = 'accuracy' and m.scope_id = h.scope_id
  and m.model_name = h.model_name) as acc,
  coalesce((select string_agg(key, ', ' order by key) from params p where p.scope_id = h.scope_id and p.model_name = h.model_name), '') as pk,
  coalesce((select string_agg(t, ', ' order by t) from (select printf('%s: %.4f', key, latest - previous) as t, * from mets
    where latest - previous is not null) m where m.scope_id = h.scope_id and m.model_name = h.model_name), '') as md
  from heads h join counts c using (scope_id, model_name)),
evidence as (select alert_id, scope_id, 'feature_drift' as evidence_type, 1 as step, pos as position, 'drift_detected' as status,
  feature_name, p_value as score,
  printf('Feature ''%s'' mean shifted from %.4f to %.4f (KS p-value: %.4e).', feature_name, baseline_mean, target_mean, p_value) as description
  from drift where is_drifted
  union all select a.alert_id, a.scope_id, 'model_registry_diff', 2, 0, 'multiple_versions_detected', null, acc,
  printf('Compared version %d vs version %d. Param changes: [%s]. Metric deltas: {{%s}}.', latest_version, previous_version, pk, md)
  from rep join alerts a using (scope_id, model_name) where version_count > 1
  union all select alert_id, scope_id, 'git_commit', 3, -epoch_us(committed_at), 'commit_found', null, null, summary from cw
  union all select alert_id, scope_id, 'label_drift', 4, 0, 'drift_detected', null, drift_delta,
  printf('Target approval rate shifted from %.4f to %.4f (Delta: %.4f, Threshold: %.4f).', baseline_mean, target_mean, drift_delta, 0.02::double)
  from lshift where is_drifted
  union all select alert_id, scope_id, 'feature_staleness', 5, 0, 'staleness_detected', null, mean_lag_days,
  printf('Feature store staleness check: average feature age lag is %.2f days (Max: %.2f days, Threshold: %s days).',
    mean_lag_days, max_lag_days, '2.5') from fresh where is_stale)"""


def fleet_causes() -> str:
    """The same with a scope per user."""
    text = segment_evidence() + ",\n" + causes("k", "value")
    lang = COMMITS[COMMITS.index("case regexp"):COMMITS.index(" end as scope_id") + 4]
    return (text.replace("c.c_mktsegment as scope_id", "cast(e.entity_id as varchar) as scope_id")
            .replace("c_mktsegment as scope_id", "cast(o_custkey as varchar) as scope_id")
            .replace(lang, "cast(page_id as varchar)"))


def segment_causes() -> str:
    return segment_evidence() + ",\n" + causes("k", "value")


TWO_RUNS = f"""runs as (select *, alert_ts as ts, alert_id || '|' || {stamp('alert_ts')} as investigation_id from causes
  union all select *, alert_ts + interval 1 day, alert_id || '|' || {stamp('alert_ts + interval 1 day')} from causes)"""


def scenarios(source: str, ordinal: str) -> str:
    mode = lambda pick: "(case (ordinal - 1) % 7 " + " ".join(
        f"when {i} then {pick(m)}" for i, m in enumerate(fv.SCENARIO_MODES)) + " end)"
    return f"""sc as (select printf('sc_%03d', ordinal) as scenario_id, {mode(lambda m: q(m[0]))} as injected_failure,
  {mode(lambda m: q(m[1]) if m[1] else 'null')} as injected_feature, {mode(lambda m: q(m[3]))} as true_root_cause,
  {mode(lambda m: q(','.join(m[2])))} as expected,
  date '2024-01-17' + {h("printf('sc_%03d', ordinal)", '42', 6)}::int as injection_date
  from (select {ordinal} as ordinal from {source}))"""


def nation_causes() -> str:
    hit = "avg((prediction = true_label)::int::double)"
    expected = " ".join(f"when {q(k)} then {q(v)}" for k, v in fv.EXPECTED_EVIDENCE_TYPES.items())
    return f"""with {EV}, {scenarios('nation', 'n_nationkey + 1')},
own as (select c_custkey as entity_id, s.scenario_id as scope_id, s.injected_failure as mode, s.injection_date as inj
  from customer join sc s on s.scenario_id = printf('sc_%03d', c_nationkey + 1)),
rw as (select e.* exclude (scope_id), e.scope_id as event_type, o.scope_id, mode, inj, ts::date >= inj as late,
  {h('event_id', 'band')} as bs from ev e join own o using (entity_id)),
vw as (select scope_id, entity_id, ts, value, case when mode = 'feature_drift' and late then
  (case when bs < 400 then 1 when bs < 700 then 2 when bs < 900 then 3 when bs < 980 then 4 else 5 end) else
  (case when bs < 50 then 1 when bs < 200 then 2 when bs < 600 then 3 when bs < 900 then 4 else 5 end) end as band,
  case when mode = 'pipeline_bug' and late and {h('event_id', 'zero')} < 300 then 0.0 else k end as k
  from rw where event_type not in ('click', 'view') and not (mode = 'stale_feature' and late)),
r0 as (select scope_id, entity_id, ts, event_id, mode, inj, late, case when mode = 'label_shift' and late and k > 50
  and {h('event_id', 'thin')} >= 400 then 0 else (k > 50)::int end as true_label,
  case when mode = 'bad_model_deploy' and late then 2 else 1 end as version from rw where event_type in ('click', 'view')),
rq as (select *, case when {h('event_id', 'model')} < (case when version = 2 then 500 else 850 end) then true_label
  else 1 - true_label end as prediction from r0),
lg as (select r.*, v.band, v.k, case when mode = 'serving_skew' and late then v.value * 100 else v.value end as value,
  v.band as s_band, v.k as s_k, v.value as s_value
  from rq r asof left join vw v on r.scope_id = v.scope_id and r.entity_id = v.entity_id and r.ts >= v.ts),
alerts as (select scope_id as alert_id, scope_id, 'events' as model_name, 'accuracy' as alert_metric,
  {hit} filter (where late) as alert_value, inj::timestamp as alert_ts, timestamp '2024-01-01' as b0, timestamp '2024-01-14' as b1,
  timestamp '2024-01-15' as a0, timestamp '2024-01-30' as a1 from rq group by scope_id, inj),
vs as (select scope_id, version, {hit} as accuracy from rq group by all),
rep as (select scope_id, count(*) as n, max(accuracy) filter (where version = 2) - max(accuracy) filter (where version = 1) as acc
  from vs group by all),
cm as (select s.scenario_id as scope_id, s.injection_date::timestamp - interval 5 day + to_minutes({h('page_id', 'commit', 14400)}) as committed_at
  from pages join sc s on s.scenario_id = printf('sc_%03d', {h('page_id', 'owner', 25)} + 1)),
{sliced('vw')}, {drift(['band', 'k', 'value'])}, {label_shift('lg', 0.15)}, {freshness('lg', 'vw', 2.0)},
au as (select a.alert_id, f, avg((abs(x - y) > 1e-9 * greatest(abs(x), abs(y), 1.0))::int::double) as rate from
  (select scope_id, ts, unnest(['band', 'k', 'value']) as f, unnest([band::double, k, value]) as x,
    unnest([s_band::double, s_k, s_value]) as y from lg)
  join alerts a using (scope_id) where ts between a0 and a1 and x is not null and y is not null group by all),
evidence as (select alert_id, scope_id, 'feature_drift' as evidence_type, feature_name, p_value as score from drift where is_drifted
  union all select a.alert_id, a.scope_id, 'model_registry_diff', null, acc from rep join alerts a using (scope_id) where n > 1
  union all select a.alert_id, a.scope_id, 'git_commit', null, null from cm join alerts a using (scope_id)
  where committed_at between alert_ts - interval 1 day and alert_ts + interval 1 day
  union all select alert_id, scope_id, 'label_drift', null, drift_delta from lshift where is_drifted
  union all select alert_id, scope_id, 'feature_staleness', null, mean_lag_days from fresh where is_stale
  union all select alert_id, alert_id, 'serving_skew', f, rate from au where rate > 0.05),
{causes('k', 'value')},
types as (select alert_id as scenario_id, list_sort(list(distinct evidence_type)) as types from evidence group by alert_id),
cov as (select s.scenario_id, s.injected_failure, coalesce(t.types, []) as types, c.cause, c.confidence,
  case when c.cause is null then false else len(list_filter(string_split(s.expected, ','), lambda e:
    (case e {expected} end) is not null and not list_contains(coalesce(t.types, []), case e {expected} end))) = 0
  end as ok from sc s left join types t using (scenario_id) left join causes c on c.scope_id = s.scenario_id),
res as (select scenario_id, injected_failure as failure_mode, coalesce(cause, 'error') as predicted_cause,
  coalesce(cause = injected_failure, false)::int as is_correct, coalesce(confidence, 0.0) as confidence,
  case when cause is null then 0.0 else 7200.0 end::double as latency_sec, ok::int as evidence_correct from cov)"""


def oracle_sql() -> dict[str, str]:
    ev = f"with {EV}"
    pur, oth = "(select * from ev where scope_id = 'purchase')", "(select * from ev where scope_id <> 'purchase')"
    clamp = "trunc(greatest(least(value * 5, 850), 300))::int"
    clamp_f = clamp.replace("value", "f_value")
    score = lambda c, inc, d, y: f"1 / (1 + exp(-(0.012 * ({c} - 600.0) + 0.7 * {inc} + -3.2 * {d} + 0.06 * {y} + -1.2)))"
    late = "ts::date >= date '2024-01-16'"
    band = "(case when s < 50 then 1 when s < 200 then 2 when s < 600 then 3 when s < 900 then 4 else 5 end)"
    shifted = "(case when s < 400 then 1 when s < 700 then 2 when s < 900 then 3 when s < 980 then 4 else 5 end)"
    pit = f"""pit as (select l.event_id, l.entity_id, l.ts, r.value as f_value, r.k as f_k, r.ts as f_ts
      from {oth} l asof left join {pur} r on l.entity_id = r.entity_id and l.ts >= r.ts)"""
    newest = f"nw as (select * from {pur} qualify row_number() over (partition by entity_id order by ts desc, ingest_seq desc) = 1)"
    items = lambda p="asymptotic": f"""with li as (select *, l_returnflag as scope_id from lineitem),
      alerts as (select distinct scope_id as alert_id, scope_id, timestamp '1996-01-01' as b0, timestamp '1996-12-31' as b1,
      timestamp '1998-01-01' as a0, timestamp '1998-06-30' as a1 from li), {sliced('li', 'l_shipdate')},
      {drift(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], p=p)}"""
    days = f"""alerts as (select distinct scope_id || '-' || strftime(ts, '%Y%m%d') as alert_id, scope_id, ts::date::timestamp - interval 10 day as b0,
      ts::date::timestamp - interval 1 day as b1, ts::date::timestamp as a0, ts::date::timestamp + interval 3 day as a1 from ev)"""
    users = """us as (select * replace (cast(entity_id as varchar) as scope_id) from ev),
      alerts as (select distinct scope_id as alert_id, scope_id, timestamp '2024-01-01' as b0, timestamp '2024-01-06' as b1,
      timestamp '2024-01-16' as a0, timestamp '2024-01-21' as a1 from us)"""
    daily = """da as (select scope_id, ts::date as day, count(*) as n, avg((prediction = true_label)::int::double) as accuracy
      from ev group by all)"""
    customers = f"with {scenarios('customer', 'c_custkey + 1')}"
    status = f"""{customers}, stt as (select sc.*, (scenario_id in (select printf('sc_%03d', user_id + 1) from events))::int
      as is_materialized from sc)"""
    starts = lambda p: f"len(list_filter(ls, lambda x: starts_with(x, '{p}')))"
    pct = lambda c: f"coalesce(avg({c}::double) * 100, 0)"
    return {
        "scan_feature_view": f"{ev} select event_id, entity_id, {stamp('ts')} as ts, value, k from ev where scope_id = 'purchase'",
        "logs_in_window": f"""{ev} select event_id, scope_id, {stamp('ts')} as ts, prediction, true_label from ev
            where ts between timestamp '2024-01-10' and timestamp '2024-01-20'""",
        "discovered_features": f"""{ev} select 'value' as feature_name, count(value) as n from {pur}
            union all select 'k', count(k) from {pur}""",
        "two_window_slice": f"""{ev}, {scope_alerts('ev')}, {sliced('ev')} select alert_id, event_id, in_base::int as in_base,
            in_target::int as in_target from sl""",
        "two_window_profile": f"""{ev}, {scope_alerts('ev')}, {sliced('ev')}, {long(['value', 'k'])}
            select alert_id, feature_name, count(*) filter (where in_base) as baseline_count,
            count(*) filter (where in_target) as target_count, {r6('avg(v) filter (where in_base)')} as baseline_mean,
            {r6('avg(v) filter (where in_target)')} as target_mean, {r6('stddev_pop(v) filter (where in_base)')} as baseline_std,
            {r6('stddev_pop(v) filter (where in_target)')} as target_std from long group by all""",
        "before_after_profile": f"""{ev} select scope_id, ({late})::int as after, count(*) as n, {r6('avg(value)')} as mean_value,
            {r6('avg(k)')} as mean_k from ev group by all""",
        "feature_drift": f"{items()} {DRIFT_SELECT}",
        "feature_drift_corrected": f"{items('corrected')} {DRIFT_SELECT}",
        "feature_drift_exact": f"with recursive {EV}, {users}, {sliced('us')}, {drift(['value', 'k'], p='exact')} {DRIFT_SELECT}",
        "drift_all_alerts": f"{ev}, {days}, {sliced('ev')}, {drift(['value', 'k'])} {DRIFT_SELECT}",
        "drift_status": f"""{ev}, {users}, {sliced('us')}, {drift(['value', 'k'], ['value', 'k', 'absent'])}
            select alert_id, feature_name, status, baseline_count, target_count from drift""",
        "pit_features": f"{ev}, {pit} select event_id, entity_id, f_value, f_k, {stamp('f_ts')} as f_ts from pit",
        "feature_snapshots": f"""{ev}, days as (select unnest([date '2024-01-08', date '2024-01-15', date '2024-01-22']) as day)
            select day::varchar as day, entity_id, {stamp('ts')} as ts, value as f_value, k as f_k from days join {pur} p on p.ts < day
            qualify row_number() over (partition by day, entity_id order by ts desc, ingest_seq desc) = 1""",
        "pit_window": f"""{ev}, {pit} select event_id, entity_id, f_value, f_k, {stamp('f_ts')} as f_ts from pit
            where ts between timestamp '2024-01-16' and timestamp '2024-01-20 12:00:00'""",
        "pit_orders": f"""with l as (select l_orderkey, l_linenumber, o_custkey, l_shipdate as ts from lineitem
            join orders on l_orderkey = o_orderkey),
            r as (select o_custkey, o_orderdate as ts, max(o_orderkey) as last_order, arg_max(o_totalprice, o_orderkey) as last_price
              from orders group by all)
            select l_orderkey, l_linenumber, l.o_custkey, {stamp('l.ts')} as ts, last_price, last_order::double as last_order
            from l asof left join r on l.o_custkey = r.o_custkey and l.ts >= r.ts""",
        "stream_push": f"{ev} select event_id, entity_id, {stamp('ts')} as ts, value, k from ev where scope_id = 'purchase'",
        "stream_late_rows": f"""{ev} select scope_id, ts::date::varchar as day, count(*) as n from ev where {h('event_id', 'arrival')} < 100
            and ts::date + interval 1 day <= (select max(ts) from ev where {h('event_id', 'arrival')} >= 100) - interval 5 day group by all""",
        "online_features": f"""{ev}, {newest} select entity_id, {stamp('ts')} as ts, value, k from nw
            where entity_id in (select c_custkey from customer)""",
        "assembled_log": f"""{ev}, {newest} select o.event_id, o.entity_id, o.prediction, o.true_label, nw.value, nw.k
            from {oth} o join nw using (entity_id)""",
        "feature_freshness": f"""{ev}, {SEGMENT}, {scope_alerts('sv')}, {freshness('sv', 'vw', 2.0)} select alert_id, status, log_count,
            matched_count, {r6('mean_lag_days')} as mean_lag_days, {r6('max_lag_days')} as max_lag_days,
            {r6('share_over_threshold')} as share_over_threshold, is_stale from fresh""",
        "serving_skew_audit": f"""{ev}, {SEGMENT}, m as (select s.scope_id, s.value, s.k, v.value as sv_, v.k as sk_ from sv s
            asof join vw v on s.scope_id = v.scope_id and s.entity_id = v.entity_id and s.ts >= v.ts),
            p as (select scope_id, 'value' as feature_name, value as x, sv_ as y from m union all select scope_id, 'k', k, sk_ from m)
            select scope_id, feature_name, count(*) as matched_count,
            {r6('avg((abs(x - y) > 1e-9 * greatest(abs(x), abs(y), 1.0))::int::double)')} as mismatch_rate,
            {r6('median(x / nullif(y, 0))')} as median_ratio,
            avg((abs(x - y) > 1e-9 * greatest(abs(x), abs(y), 1.0))::int::double) > 0.05 as is_skewed
            from p where x is not null and y is not null group by all""",
        "training_set": f"""{ev}, {pit}, s as (select *, {score(clamp_f, '(f_k / 20)', '(f_value / 600)', '(f_k / 10)')} as p from pit)
            select event_id, f_value, f_k, {r6('p')} as probability,
            case when p is not null then ({h('event_id', 'label')} / 1000.0::double < p)::int::double end as label from s""",
        "clamp_truncate": f"select event_id, {clamp} as score from events",
        "logistic_score": f"""{ev} select event_id, {r6(f"({score(clamp, '(k / 20)', '(value / 600)', '(k / 10)')}) * (case when {late} then 0.4 else 1 end)")}
            as probability from ev""",
        "label_shift": f"""{ev}, {scope_alerts('ev')}, {label_shift('ev', 0.02)} select alert_id, status, baseline_count, target_count,
            {r6('baseline_mean')} as baseline_mean, {r6('target_mean')} as target_mean, {r6('drift_delta')} as drift_delta, is_drifted
            from lshift""",
        "classification_metrics": f"""with d as (select lang, n_chars > 1000 as p, quality = 1 as y from documents join labels using (doc_id)),
            c as (select lang, count(*) filter (where p and y) as tp, count(*) filter (where p and not y) as fp,
              count(*) filter (where not p and y) as fn, count(*) filter (where not p and not y) as tn from d group by lang)
            select lang, tp, fp, fn, tn, {r6('coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)')} as accuracy,
            {r6('coalesce(tp / nullif(tp + fp, 0), 0)')} as precision, {r6('coalesce(tp / nullif(tp + fn, 0), 0)')} as recall,
            {r6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1_score from c""",
        "daily_accuracy": f"{ev}, {daily} select scope_id, day::varchar as day, n, {r6('accuracy')} as accuracy from da",
        "derived_alerts": f"""{ev}, {daily}, t as (select *, sum(accuracy * n) over w / sum(n) over w as e, count(*) over w as c from da
            window w as (partition by scope_id order by day rows between 7 preceding and 1 preceding))
            select scope_id, day::varchar as alert_day, 'accuracy' as alert_metric, {r6('accuracy')} as alert_value, {r6('e')} as expected,
            {r6('e - sqrt(e * (1 - e) / n)')} as lower_bound from t where c = 7 and accuracy < e - sqrt(e * (1 - e) / n)""",
        "registry_versions": f"""with {VERSIONS} select scope_id, model_name, latest_version::varchar as latest_version,
            previous_version::varchar as previous_version, latest_run_id, version_count,
            case when previous_version is null then 'single_version' else 'ok' end as status from heads join counts using (scope_id, model_name)""",
        "latest_two_versions": f"with {VERSIONS} select scope_id, model_name, version, version_rank, run_id from two",
        "version_history": f"""with {VERSIONS} select scope_id, model_name, version::double as version,
            (lag(version) over (partition by scope_id, model_name order by version))::double as previous_version from ver""",
        "registry_param_diff": f"with {VERSIONS} select scope_id, model_name, key, previous, latest from params",
        "registry_metric_diff": f"""with {VERSIONS} select scope_id, model_name, key, {r6('previous')} as previous, {r6('latest')} as latest,
            {r6('latest - previous')} as delta from mets""",
        "registry_report": f"""with {CUSTOMER_VERSIONS}, last as (select * from two where version_rank = 1),
            gone as (select scope_id, model_name from heads where previous_version is null),
            lines as (select scope_id, model_name, 'latest_param' as kind, 'modal_status' as key, null as previous, modal_status as latest,
                null::double as previous_number, null::double as latest_number, null::double as delta from last
              union all select scope_id, model_name, 'latest_param', 'kind', null, 'forest', null, null, null from last
              union all select scope_id, model_name, 'latest_param', 'seed', null, seed, null, null, null from last where seed is not null
              union all select scope_id, model_name, 'latest_metric', 'accuracy', null, null, null, accuracy, null from last
              union all select scope_id, model_name, 'latest_metric', 'price', null, null, null, price, null from last
              union all select scope_id, model_name, 'latest_metric', 'open_share', null, null, null, open_share, null from last where open_share is not null
              union all select scope_id, model_name, 'param_change', key, previous, latest, null, null, null from params anti join gone using (scope_id, model_name)
              union all select scope_id, model_name, 'metric_change', key, null, null, previous, latest, latest - previous from mets anti join gone using (scope_id, model_name))
            select scope_id, model_name, case when previous_version is null then 'single_version' else 'ok' end as status, version_count,
              latest_version::varchar as latest_version, previous_version::varchar as previous_version, latest_run_id, kind, key, previous, latest,
              {r6('previous_number')} as previous_number, {r6('latest_number')} as latest_number, {r6('delta')} as delta
            from lines join heads using (scope_id, model_name) join counts using (scope_id, model_name)""",
        "evidence_payload": f"""{ev}, {SEGMENT}, {scope_alerts('sv')}, {VERSIONS} select alert_id, key, {r6('previous')} as previous, {r6('latest')} as latest,
            {r6('latest - previous')} as delta from alerts join counts using (scope_id, model_name) join mets using (scope_id, model_name) where version_count > 1""",
        "commits_in_window": f"""{ev}, {SEGMENT}, {scope_alerts('sv')}, {COMMITS} select alert_id, commit_hash,
            {stamp('committed_at')} as committed_at, message, summary, url as changed_file from cw""",
        "diff_line_profile": f"""with d as (select page_id, url, case when length(html) > 0 then string_split(html, chr(10)) else [] end as ls
            from pages) select cast(page_id as varchar) as commit_hash, url as file_path, {starts('+')} as additions,
            {starts('-')} as deletions, {starts('@@')} as meta, len(ls) as lines,
            len(ls) - {starts('+')} - {starts('-')} - {starts('@@')} as context from d""",
        "evidence_all": f"""{segment_evidence()} select alert_id, evidence_type, step, position, status, feature_name,
            {r6('score')} as score from evidence""",
        "evidence_text": f"{segment_evidence()} select alert_id, evidence_type, position, description from evidence",
        "root_cause": f"{segment_causes()} select alert_id, scope_id, cause, confidence, ruled_out from causes",
        "hypothesis_status": f"""{segment_causes()}, {HYPOTHESES} select alert_id, scope_id, position, hypothesis_id, text,
            case when stands_for = cause then 'proven' else 'eliminated' end as status from hyp""",
        "evidence_hypothesis": f"""{segment_causes()}, {HYPOTHESES}, m as (select e.alert_id, e.evidence_type, e.position,
            h.position as hp, h.text, case when stands_for = cause then 'proven' else 'eliminated' end as st
            from evidence e left join hyp h on e.alert_id = h.alert_id and (contains(lower(h.text), case e.evidence_type
              {' '.join(f'when {q(k)} then {q(v)}' for k, v in fv.EVIDENCE_KEYWORDS.items())} end)
              or (e.evidence_type = 'feature_drift' and contains(e.description, 'Feature ''value''') and contains(lower(h.text), 'skew'))))
            select alert_id, evidence_type, position, coalesce(arg_max(text, hp), 'General Evidence') as hypothesis,
            coalesce(arg_max(st, hp), 'unresolved') as hypothesis_status from m group by alert_id, evidence_type, position""",
        "investigate": f"""{segment_causes()}, n as (select alert_id, count(*) as ne, count(distinct evidence_type) as nt
            from evidence group by alert_id) select alert_id, scope_id, alert_metric, {r6('alert_value')} as alert_value, cause, confidence,
            ruled_out, coalesce(ne, 0) as n_evidence, coalesce(nt, 0) as n_types from causes left join n using (alert_id)""",
        "investigate_fleet": f"""{fleet_causes()}, n as (select alert_id, count(*) as ne, count(distinct evidence_type) as nt
            from evidence group by alert_id) select alert_id, {r6('alert_value')} as alert_value, cause, confidence,
            coalesce(ne, 0) as n_evidence, coalesce(nt, 0) as n_types from causes left join n using (alert_id)""",
        "latest_investigation": f"""{segment_causes()}, {TWO_RUNS} select scope_id, investigation_id, {stamp('ts')} as ts, cause from runs
            qualify row_number() over (partition by scope_id order by ts desc) = 1""",
        "investigations_nested": f"""{segment_causes()}, {TWO_RUNS}, ev2 as (select alert_id, count(*) as n,
            string_agg(evidence_type, ',' order by evidence_type, step, position) as types from evidence group by alert_id)
            select investigation_id, {stamp('ts')} as ts, cause, case when ts = alert_ts then coalesce(n, 0) else 0 end as n_evidence,
            case when ts = alert_ts then coalesce(types, '') else '' end as evidence_types from runs left join ev2 using (alert_id)""",
        "investigations_paged": f"""{segment_causes()}, {TWO_RUNS}, ev2 as (select alert_id, evidence_type, row_number() over (partition by alert_id
            order by step, position, evidence_type) as n, ceil(count(*) over (partition by alert_id) / 2.0)::bigint as pages from evidence),
            pg as (select alert_id, ceil(n / 2.0)::bigint as page, max(pages) as pages, string_agg(evidence_type, ',' order by n) as types from ev2 group by all)
            select investigation_id, coalesce(page, 1) as page, coalesce(pages, 1) as pages, cause, coalesce(types, '') as evidence_types
            from runs left join pg on runs.alert_id = pg.alert_id and ts = alert_ts""",
        "saved_investigations": f"""{segment_causes()}, {TWO_RUNS}, ev2 as (select alert_id, count(*) as n from evidence group by alert_id)
            select investigation_id, {stamp('ts')} as ts, cause, case when ts = alert_ts then coalesce(n, 0) else 0 end as n_evidence
            from runs left join ev2 using (alert_id)""",
        "scenario_table": f"""{customers} select scenario_id, injected_failure, injected_feature, injection_date::varchar as injection_date,
            true_root_cause, expected from sc""",
        "scenario_status": f"{status} select scenario_id, injected_failure, is_materialized from stt",
        "triage_bucket": f"""{status} select scenario_id, case when is_materialized = 0 then 'pending' when injected_failure = 'control'
            then 'resolved' else 'active' end as bucket, case injected_failure when 'control' then 'Informational'
            when 'pipeline_bug' then 'Critical Risk' when 'bad_model_deploy' then 'Critical Risk' else 'High Risk' end as risk from stt""",
        "scenarios_limit": f"{customers} select scenario_id, injected_failure from sc order by scenario_id limit 20",
        "eval_results": f"{nation_causes()} select * from res",
        "eval_summary": f"""{nation_causes()} select count(*) as total_evaluated, {r6(pct('is_correct'))} as overall_accuracy,
            {r6(pct('evidence_correct'))} as evidence_correctness,
            {r6("coalesce(avg((1 - is_correct)::double) filter (where failure_mode = 'control') * 100, 0)")} as false_hypothesis_rate,
            {r6('coalesce(avg(latency_sec), 0)')} as mean_latency from res""",
        "eval_breakdown": f"""{nation_causes()} select failure_mode as failure_type, count(*) as count, {r6(pct('is_correct'))} as accuracy,
            {r6(pct('evidence_correct'))} as evidence_correctness, {r6('avg(latency_sec)')} as avg_latency
            from res group by grouping sets ((), (failure_mode))""",
        "evidence_coverage": f"""{nation_causes()} select scenario_id, array_to_string(types, ',') as types, ok::int as evidence_correct from cov""",
        "perturb_shift": f"""select event_id, case when {late} then {shifted} else {band} end as band
            from (select *, {h('event_id', 'band')} as s from events)""",
        "perturb_zero": f"{ev} select event_id, case when {late} and {h('event_id', 'zero')} < 300 then 0 else k end as k from ev",
        "perturb_scale": f"select event_id, {r6(f'case when {late} then value * 100.0::double else value end')} as value from events",
        "perturb_labels": f"""{ev} select event_id, case when {late} and true_label = 1 and {h('event_id', 'thin')} >= 400 then 0
            else true_label end as true_label from ev""",
        "perturb_stale": f"{ev} select event_id, entity_id, {stamp('ts')} as ts from {pur} where not ({late})",
        "perturb_shuffle": f"""{ev}, sh as (select event_id, scope_id, true_label, count(*) over (partition by scope_id) as n,
            row_number() over (partition by scope_id order by md5('shuffle' || event_id::varchar), event_id) as rn from ev)
            select a.event_id, a.scope_id, b.true_label from sh a join sh b on a.scope_id = b.scope_id and b.rn = a.rn % a.n + 1""",
        "stream_daily_metrics": f"""{ev} select scope_id, ts::date::varchar as day, count(*) as n,
            {r6('avg((prediction = true_label)::int::double)')} as accuracy, {r6('avg(true_label)')} as label_rate,
            {r6('avg(value)')} as feature_mean from ev group by all""",
        "stream_online_features": f"{ev}, {newest} select entity_id, {stamp('ts')} as ts, value, k from nw",
    }
