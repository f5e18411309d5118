"""DuckDB SQL for each registered query, over the driver's base tables.

The fixture views and the analysis stages are written once as ``WITH`` clauses
(a shared prefix) in the plainest SQL form: whole-person windows, correlated
filters, ``ASOF`` joins. They are an independent statement of the same rules, not
a translation of the Spark plans. DuckDB only evaluates the clauses a query uses.
"""

from __future__ import annotations

from staylink.operators.comorbidity import CHARLSON_HIERARCHY, charlson_rows
from staylink.sources.fixtures import icd_codes

PERIOD_START = "DATE '1996-01-01'"
PERIOD_END = "DATE '2000-12-31'"
ORDER = "start_date, end_date, episode_id"

PREFIX = f"""
WITH
fx_episode AS (
  SELECT o.o_custkey AS person_id, o.o_orderkey AS episode_id,
         CAST(o.o_orderdate AS DATE) AS start_date,
         CAST(CAST(o.o_orderdate AS DATE) + CAST(coalesce(l.los, 0) AS INTEGER) AS DATE) AS end_date,
         CAST(40 + o.o_custkey % 40 + year(o.o_orderdate) - 1995 AS INTEGER) AS age,
         o.o_orderpriority AS diag_code, o.o_orderstatus AS mode
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS los FROM lineitem GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey),
fx_death AS (
  SELECT c_custkey AS person_id,
         CAST(DATE '1999-01-01' + CAST(c_custkey % 1300 AS INTEGER) AS DATE) AS death_date,
         CAST(60 + c_custkey % 30 AS INTEGER) AS age_death
  FROM customer WHERE c_acctbal < 1500
  UNION ALL
  SELECT c_custkey, CAST(DATE '1998-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS DATE),
         CAST(59 + c_custkey % 30 AS INTEGER)
  FROM customer WHERE c_acctbal < 1500 AND c_custkey % 10 = 0),
fx_diagnosis AS (
  SELECT l.l_orderkey AS episode_id, p.p_type AS code
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
ep AS (
  SELECT DISTINCT * FROM fx_episode
  WHERE start_date >= {PERIOD_START} AND end_date <= {PERIOD_END} AND person_id IS NOT NULL),
flagged AS (
  SELECT *, CAST(age >= 65 AS INTEGER) AS age_flag,
         CAST(coalesce(regexp_matches(diag_code, '^[12]-'), false) AS INTEGER) AS hip_flag
  FROM ep),
seq1 AS (
  SELECT *,
         CAST(row_number() OVER (ORDER BY person_id, {ORDER}) AS BIGINT) AS file_seq,
         CAST(row_number() OVER (PARTITION BY person_id ORDER BY {ORDER}) AS INTEGER) AS person_seq,
         CAST(sum(hip_flag) OVER (PARTITION BY person_id ORDER BY {ORDER}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS hip_cumcount
  FROM flagged),
seq AS (
  SELECT *, CAST(hip_cumcount > 0 AS INTEGER) AS post_index,
         CAST(CASE WHEN hip_cumcount > 0
              THEN row_number() OVER (PARTITION BY person_id, hip_cumcount > 0 ORDER BY {ORDER})
              ELSE 0 END AS INTEGER) AS index_seq,
         CAST(CASE WHEN hip_flag = 1
              THEN row_number() OVER (PARTITION BY person_id, hip_flag ORDER BY {ORDER})
              ELSE 0 END AS INTEGER) AS hip_seq
  FROM seq1),
cohort AS (
  SELECT * FROM seq
  WHERE person_id IN (SELECT person_id FROM seq WHERE hip_flag = 1 AND age_flag = 1)),
deaths AS (SELECT DISTINCT * FROM fx_death),
dve AS (
  SELECT d.person_id, d.death_date, d.age_death,
         CAST(count(c.episode_id) AS BIGINT) AS n_episodes,
         CAST(count(c.episode_id) FILTER (WHERE c.start_date > d.death_date) AS BIGINT) AS n_after,
         max(c.start_date) AS last_start
  FROM deaths d LEFT JOIN cohort c ON c.person_id = d.person_id
  GROUP BY d.person_id, d.death_date, d.age_death),
per_person AS (SELECT person_id, count(*) AS n_records FROM dve GROUP BY person_id),
candidates AS (
  SELECT v.person_id, v.death_date, v.age_death,
         row_number() OVER (PARTITION BY v.person_id ORDER BY v.death_date DESC, v.age_death DESC) AS rk
  FROM dve v JOIN per_person p ON p.person_id = v.person_id
  WHERE p.n_records = 1 OR v.n_after = 0),
resolved AS (SELECT person_id, death_date, age_death FROM candidates WHERE rk = 1),
dropped AS (
  SELECT person_id, 'no record before the last episode' AS reason FROM per_person
  WHERE person_id NOT IN (SELECT person_id FROM resolved)),
linked AS (
  SELECT c.*, r.death_date, r.age_death
  FROM cohort c LEFT JOIN resolved r ON r.person_id = c.person_id
  WHERE c.person_id NOT IN (SELECT person_id FROM dropped)),
st1 AS (
  SELECT *,
         max(end_date) OVER (PARTITION BY person_id ORDER BY {ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
         lag(mode) OVER (PARTITION BY person_id ORDER BY {ORDER}) AS prev_mode
  FROM linked),
st2 AS (
  SELECT *, CASE WHEN prev_end IS NULL OR start_date > prev_end
                   OR (start_date = prev_end AND NOT coalesce(prev_mode IN ('P'), false))
              THEN 1 ELSE 0 END AS brk
  FROM st1),
st3 AS (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY person_id ORDER BY {ORDER}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS stay_seq
  FROM st2),
st4 AS (
  SELECT *,
         CAST(row_number() OVER (PARTITION BY person_id, stay_seq ORDER BY {ORDER}) - 1 AS INTEGER) AS trans_seq,
         CAST(count(*) OVER (PARTITION BY person_id, stay_seq) AS INTEGER) AS stay_size,
         min(start_date) OVER (PARTITION BY person_id, stay_seq) AS admdate_first,
         max(end_date) OVER (PARTITION BY person_id, stay_seq) AS sepdate_last
  FROM st3),
stays AS (SELECT *, CAST(date_diff('day', admdate_first, sepdate_last) AS INTEGER) AS totlos FROM st4),
hs AS (
  SELECT person_id, stay_seq,
         CAST(row_number() OVER (PARTITION BY person_id ORDER BY {ORDER}) AS INTEGER) AS hf_stays_all
  FROM stays WHERE trans_seq = 0 AND hip_flag = 1),
hip_stays AS (
  SELECT s.*, CAST(coalesce(h.hf_stays_all, 0) AS INTEGER) AS hf_stays_all
  FROM stays s LEFT JOIN hs h ON h.person_id = s.person_id AND h.stay_seq = s.stay_seq),
first_los AS (SELECT person_id, hip_seq, totlos FROM stays WHERE hip_seq = 1),
idx AS (SELECT *, sepdate_last AS discharge_date FROM stays WHERE hip_seq = 1),
nxt AS (
  SELECT i.person_id, min(a.start_date) AS next_admission_date
  FROM idx i JOIN stays a ON a.person_id = i.person_id AND a.start_date > i.discharge_date
  GROUP BY i.person_id),
readm AS (
  SELECT i.*, n.next_admission_date FROM idx i LEFT JOIN nxt n ON n.person_id = i.person_id),
cens0 AS (
  SELECT *, CAST(next_admission_date IS NOT NULL AS INTEGER) AS event,
         least(death_date, {PERIOD_END}) AS censor_date
  FROM readm),
cens1 AS (
  SELECT *, CASE WHEN event = 1 THEN next_admission_date ELSE censor_date END AS followup_end FROM cens0),
cens AS (SELECT *, CAST(date_diff('day', discharge_date, followup_end) AS INTEGER) AS time_to_next FROM cens1),
code_map AS (SELECT * FROM (VALUES ('PROMO', 'promo', 1), ('LARGE', 'large', 2)) t(prefix, condition, weight)),
dx AS (
  SELECT DISTINCT episode_id, upper(replace(code, '.', '')) AS code FROM fx_diagnosis
  WHERE episode_id IN (SELECT episode_id FROM cens)),
conditions AS (
  SELECT DISTINCT dx.episode_id, m.condition, m.weight
  FROM dx JOIN code_map m ON starts_with(dx.code, m.prefix)),
score AS (SELECT episode_id, sum(weight) AS s FROM conditions GROUP BY episode_id),
scored0 AS (
  SELECT c.*, CAST(coalesce(s.s, 0) AS INTEGER) AS cci_score
  FROM cens c LEFT JOIN score s ON s.episode_id = c.episode_id),
scored AS (
  SELECT *,
         CASE WHEN cci_score < 1 THEN '[0,1)' WHEN cci_score < 3 THEN '[1,3)' ELSE '[3,Inf)' END AS ccicat,
         CASE WHEN cci_score < 1 THEN '0' WHEN cci_score < 3 THEN '1-2' ELSE '3+' END AS cci_group,
         CASE WHEN cci_score < 1 THEN 'CCI 0' WHEN cci_score < 3 THEN 'CCI 1–2' ELSE 'CCI 3+' END AS cci_label,
         CAST(CASE WHEN cci_score < 1 THEN 1 WHEN cci_score < 3 THEN 2 ELSE 3 END AS INTEGER) AS cci_rank
  FROM scored0),
subj AS (
  SELECT cci_label, time_to_next, event FROM scored
  WHERE cci_label IS NOT NULL AND time_to_next IS NOT NULL AND time_to_next >= 0 AND event IS NOT NULL),
km0 AS (
  SELECT cci_label, time_to_next, CAST(sum(event) AS BIGINT) AS n_event, CAST(count(*) AS BIGINT) AS m
  FROM subj GROUP BY cci_label, time_to_next),
km1 AS (
  SELECT *, CAST(sum(m) OVER (PARTITION BY cci_label ORDER BY time_to_next DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_risk
  FROM km0),
km2 AS (
  SELECT *, product(1.0 - n_event / n_risk) OVER w AS surv,
         max(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER w AS zero,
         sum(CASE WHEN n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0.0 END) OVER w AS h
  FROM km1
  WINDOW w AS (PARTITION BY cci_label ORDER BY time_to_next ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
km AS (
  SELECT cci_label, time_to_next, n_risk, n_event, CAST(m - n_event AS BIGINT) AS n_censor, surv,
         CASE WHEN zero = 0 THEN sqrt(h) END AS se_log_surv,
         CASE WHEN zero = 0 THEN exp(ln(surv) - 1.959963984540054 * sqrt(h)) END AS lower,
         CASE WHEN zero = 0 THEN least(1.0, exp(ln(surv) + 1.959963984540054 * sqrt(h))) END AS upper
  FROM km2),
lr0 AS (
  SELECT time_to_next,
         count(*) FILTER (WHERE cci_label = 'CCI 0') AS m0,
         count(*) FILTER (WHERE cci_label = 'CCI 1–2') AS m1,
         count(*) FILTER (WHERE cci_label = 'CCI 3+') AS m2,
         coalesce(sum(event) FILTER (WHERE cci_label = 'CCI 0'), 0) AS d0,
         coalesce(sum(event) FILTER (WHERE cci_label = 'CCI 1–2'), 0) AS d1,
         coalesce(sum(event) FILTER (WHERE cci_label = 'CCI 3+'), 0) AS d2
  FROM subj GROUP BY time_to_next),
lr1 AS (
  SELECT *,
         sum(m0) OVER w AS n0, sum(m1) OVER w AS n1, sum(m2) OVER w AS n2
  FROM lr0 WINDOW w AS (ORDER BY time_to_next DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lr2 AS (
  SELECT *, d0 + d1 + d2 AS d, n0 + n1 + n2 AS n FROM lr1),
lr3 AS (
  SELECT *, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0.0 END AS w FROM lr2 WHERE d > 0),
lr AS (
  SELECT sum(d0) AS o0, sum(d1) AS o1, sum(d2) AS o2,
         sum(d * n0 / n) AS e0, sum(d * n1 / n) AS e1, sum(d * n2 / n) AS e2,
         sum(w * (n0 / n) * (1 - n0 / n)) AS v00, sum(w * (n0 / n) * (0 - n1 / n)) AS v01,
         sum(w * (n0 / n) * (0 - n2 / n)) AS v02,
         sum(w * (n1 / n) * (0 - n0 / n)) AS v10, sum(w * (n1 / n) * (1 - n1 / n)) AS v11,
         sum(w * (n1 / n) * (0 - n2 / n)) AS v12,
         sum(w * (n2 / n) * (0 - n0 / n)) AS v20, sum(w * (n2 / n) * (0 - n1 / n)) AS v21,
         sum(w * (n2 / n) * (1 - n2 / n)) AS v22
  FROM lr3),
dirty0 AS (
  SELECT CASE WHEN episode_id % 97 <> 0 THEN person_id END AS person_id, episode_id,
         CASE WHEN episode_id % 101 <> 0 THEN start_date END AS start_date, end_date,
         CASE WHEN episode_id % 11 <> 0 THEN age END AS age,
         CASE WHEN episode_id % 13 <> 0 THEN diag_code END AS diag_code,
         CASE WHEN episode_id % 7 <> 0 THEN mode END AS mode
  FROM fx_episode),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE episode_id % 17 = 0),
dirty_ep AS (
  SELECT DISTINCT * FROM dirty
  WHERE start_date >= {PERIOD_START} AND end_date <= {PERIOD_END} AND person_id IS NOT NULL),
dirty_flagged AS (
  SELECT *, CAST(age >= 65 AS INTEGER) AS age_flag,
         CAST(coalesce(regexp_matches(diag_code, '^[12]-'), false) AS INTEGER) AS hip_flag
  FROM dirty_ep),
hot AS (
  SELECT * REPLACE (
    CAST(CASE WHEN episode_id % 7 = 1 THEN -1 WHEN episode_id % 3 = 0 THEN 0 ELSE person_id END AS BIGINT) AS person_id,
    CASE WHEN episode_id % 7 = 1 THEN DATE '1998-05-05' ELSE start_date END AS start_date,
    CASE WHEN episode_id % 7 = 1 THEN DATE '1998-05-05' ELSE end_date END AS end_date)
  FROM flagged),
hot_seq AS (
  SELECT *, CAST(hip_cumcount > 0 AS INTEGER) AS post_index,
         CAST(CASE WHEN hip_cumcount > 0
              THEN row_number() OVER (PARTITION BY person_id, hip_cumcount > 0 ORDER BY {ORDER})
              ELSE 0 END AS INTEGER) AS index_seq,
         CAST(CASE WHEN hip_flag = 1
              THEN row_number() OVER (PARTITION BY person_id, hip_flag ORDER BY {ORDER})
              ELSE 0 END AS INTEGER) AS hip_seq
  FROM (SELECT *,
         CAST(row_number() OVER (ORDER BY person_id, {ORDER}) AS BIGINT) AS file_seq,
         CAST(row_number() OVER (PARTITION BY person_id ORDER BY {ORDER}) AS INTEGER) AS person_seq,
         CAST(sum(hip_flag) OVER (PARTITION BY person_id ORDER BY {ORDER}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS hip_cumcount
        FROM hot)),
hot1 AS (
  SELECT *,
         max(end_date) OVER (PARTITION BY person_id ORDER BY {ORDER}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
         lag(mode) OVER (PARTITION BY person_id ORDER BY {ORDER}) AS prev_mode
  FROM hot),
hot2 AS (
  SELECT *, CAST(sum(CASE WHEN prev_end IS NULL OR start_date > prev_end
                   OR (start_date = prev_end AND NOT coalesce(prev_mode IN ('P'), false))
              THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY {ORDER}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS stay_seq
  FROM hot1),
gap0 AS (
  SELECT event_id, event_type, epoch_us(ts) AS t_us,
         epoch_us((SELECT min(n.ts) FROM events n WHERE n.user_id = e.user_id AND n.ts > e.ts)) AS next_at FROM events e),
gaps AS (
  SELECT event_id, event_type, CAST(next_at IS NOT NULL AS INTEGER) AS event,
         coalesce(next_at, (SELECT max(t_us) FROM gap0)) - t_us AS gap FROM gap0),
gkm1 AS (
  SELECT *, CAST(sum(m) OVER (PARTITION BY event_type ORDER BY gap DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_risk
  FROM (SELECT event_type, gap, CAST(sum(event) AS BIGINT) AS n_event, CAST(count(*) AS BIGINT) AS m FROM gaps WHERE event_type IS NOT NULL GROUP BY ALL)),
gkm2 AS (
  SELECT *, product(1.0 - n_event / n_risk) OVER w AS surv,
         max(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER w AS zero,
         sum(CASE WHEN n_event < n_risk THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0.0 END) OVER w AS h
  FROM gkm1 WINDOW w AS (PARTITION BY event_type ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hot_stays AS (
  SELECT person_id, episode_id, start_date, end_date, mode, stay_seq,
         CAST(row_number() OVER (PARTITION BY person_id, stay_seq ORDER BY {ORDER}) - 1 AS INTEGER) AS trans_seq,
         CAST(count(*) OVER s AS INTEGER) AS stay_size, min(start_date) OVER s AS admdate_first,
         max(end_date) OVER s AS sepdate_last,
         CAST(date_diff('day', min(start_date) OVER s, max(end_date) OVER s) AS INTEGER) AS totlos
  FROM hot2 WINDOW s AS (PARTITION BY person_id, stay_seq))
"""


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


def _freq(source: str, col: str) -> str:
    return f"""
SELECT {col}, CAST(count(*) AS BIGINT) AS n,
       round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent
FROM {source} GROUP BY {col}"""


def _describe(source: str) -> str:
    return f"""
SELECT CAST(count(totlos) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE totlos IS NULL) AS BIGINT) AS n_missing,
       {_r('avg(totlos)', 'mean')}, {_r('stddev_samp(totlos)', 'sd')}, {_r('min(totlos)', 'min')},
       {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.25)', 'q1')},
       {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.5)', 'median')},
       {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.75)', 'q3')}, {_r('max(totlos)', 'max')}
FROM {source}"""


def _level_summary(source: str, col: str, label: str) -> str:
    return f"""
SELECT '{label}' AS variable, {col} AS level, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM {source} GROUP BY {col}"""


def _summary_by(col: str, label: str) -> str:
    return f"""
SELECT mode, '{label}' AS variable, {col} AS level, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY mode), 6) AS percent
FROM hip_stays WHERE mode IS NOT NULL GROUP BY mode, {col}"""


def _dup(source: str, name: str) -> str:
    return f"""
SELECT '{name}' AS "table", CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct,
       CAST(sum(c - 1) AS BIGINT) AS n_excess, sum(c - 1) > 0 AS has_duplicates
FROM (SELECT *, count(*) AS c FROM {source} GROUP BY ALL)"""


EPISODE_COLS = ["person_id", "episode_id", "start_date", "end_date", "age", "diag_code", "mode"]
EPISODE_TYPES = ["bigint", "bigint", "date", "date", "int", "string", "string"]

_PROFILE = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", '{t}' AS type, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing FROM fx_episode"
    for i, (c, t) in enumerate(zip(EPISODE_COLS, EPISODE_TYPES, strict=True))
)

_LOS_BOX = f"""
SELECT n, {_r('q1', 'q1')}, {_r('median', 'median')}, {_r('q3', 'q3')},
       {_r('min(totlos) FILTER (WHERE totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_low')},
       {_r('max(totlos) FILTER (WHERE totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_high')},
       CAST(count(*) FILTER (WHERE NOT (totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT)
         AS n_outliers
FROM first_los, (SELECT CAST(count(*) AS BIGINT) AS n,
                        quantile_cont(CAST(totlos AS DOUBLE), 0.25) AS q1,
                        quantile_cont(CAST(totlos AS DOUBLE), 0.5) AS median,
                        quantile_cont(CAST(totlos AS DOUBLE), 0.75) AS q3 FROM first_los) q
GROUP BY n, q1, median, q3"""

_TOP5 = "(SELECT person_id FROM first_los ORDER BY totlos DESC, person_id LIMIT 5)"

_KM_AT = f"""
SELECT g.cci_label, g.time_to_next,
       {_r('coalesce(b.surv, 1.0)', 'surv')},
       {_r('CASE WHEN b.surv IS NULL THEN 1.0 WHEN b.zero_so_far = 0 THEN b.lower END', 'lower')},
       {_r('CASE WHEN b.surv IS NULL THEN 1.0 WHEN b.zero_so_far = 0 THEN b.upper END', 'upper')},
       CAST(coalesce(f.n_risk, 0) AS BIGINT) AS n_risk
FROM (SELECT l.cci_label, CAST(t.t AS INTEGER) AS time_to_next
      FROM (SELECT DISTINCT cci_label FROM km) l, (SELECT unnest(range(0, 1001, 200)) AS t) t) g
ASOF LEFT JOIN (SELECT *, max(CASE WHEN surv = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cci_label ORDER BY time_to_next)
                AS zero_so_far FROM km) b
  ON g.cci_label = b.cci_label AND g.time_to_next >= b.time_to_next
ASOF LEFT JOIN km f ON g.cci_label = f.cci_label AND g.time_to_next <= f.time_to_next"""

_UNUSED = "NOT coalesce(time_to_next >= 0 AND event IS NOT NULL, false)"
_LEVELS = "'CCI 0', 'CCI 1–2', 'CCI 3+'"

_LOGRANK = " UNION ALL ".join(
    f"SELECT '{lab}' AS cci_label, {_r(f'o{i}', 'observed')}, {_r(f'e{i}', 'expected')}, "
    + ", ".join(_r(f"v{i}{j}", f"v_{j}") for j in range(3))
    + f", CAST((SELECT count(*) FROM scored WHERE cci_label = '{lab}' AND {_UNUSED}) AS BIGINT) AS n_excluded"
    + f", CAST((SELECT count(*) FROM scored WHERE cci_label IS NULL OR cci_label NOT IN ({_LEVELS})) AS BIGINT) AS n_unlisted"
    + " FROM lr"
    for i, lab in enumerate(["CCI 0", "CCI 1–2", "CCI 3+"])
)

# chi2 = u' V^-1 u with the last group left out: a 2 x 2 inverse in closed form (k = 3).
_LOGRANK_TEST = f"""
SELECT {_r('((o0 - e0) * (o0 - e0) * v11 - 2 * (o0 - e0) * (o1 - e1) * v01 + (o1 - e1) * (o1 - e1) * v00)'
           ' / (v00 * v11 - v01 * v01)', 'chi2')},
       CAST(2 AS INTEGER) AS df,
       {_r('exp(-((o0 - e0) * (o0 - e0) * v11 - 2 * (o0 - e0) * (o1 - e1) * v01 + (o1 - e1) * (o1 - e1) * v00)'
           ' / (v00 * v11 - v01 * v01) / 2)', 'p')}
FROM lr"""

_MODE_BOX = f"""
SELECT mode, n, {_r('q1', 'q1')}, {_r('median', 'median')}, {_r('q3', 'q3')},
       {_r('min(totlos) FILTER (WHERE totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_low')},
       {_r('max(totlos) FILTER (WHERE totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_high')},
       CAST(count(*) FILTER (WHERE NOT (totlos BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT)
         AS n_outliers
FROM (SELECT * FROM stays WHERE hip_seq = 1) JOIN (
  SELECT mode, CAST(count(*) AS BIGINT) AS n, quantile_cont(CAST(totlos AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST(totlos AS DOUBLE), 0.5) AS median, quantile_cont(CAST(totlos AS DOUBLE), 0.75) AS q3
  FROM stays WHERE hip_seq = 1 GROUP BY mode) q USING (mode)
GROUP BY mode, n, q1, median, q3"""

# The fixed map and pairs of the score, as VALUES; matching, suppression and sums are plain SQL.
_CHARLSON = f"""
SELECT e.episode_id, CAST(coalesce(s.s, 0) AS INTEGER) AS cci_score
FROM fx_episode e LEFT JOIN (
  SELECT episode_id, sum(weight) AS s FROM (
    SELECT DISTINCT episode_id, condition, weight FROM (
      SELECT l_orderkey AS episode_id,
             list_extract([{", ".join(f"'{c}'" for c in icd_codes())}], CAST(l_partkey % {len(icd_codes())} + 1 AS INTEGER))
               || CAST(l_partkey % 2 AS VARCHAR) AS code
      FROM lineitem) c
    JOIN (VALUES {", ".join(map(str, charlson_rows()))}) m(prefix, condition, weight) ON starts_with(c.code, m.prefix)) x
  WHERE NOT EXISTS (
    SELECT 1 FROM (VALUES {", ".join(map(str, CHARLSON_HIERARCHY.items()))}) h(mild, worse)
    JOIN (SELECT DISTINCT l_orderkey AS o,
                 list_extract([{", ".join(f"'{c}'" for c in icd_codes())}], CAST(l_partkey % {len(icd_codes())} + 1 AS INTEGER))
                   || CAST(l_partkey % 2 AS VARCHAR) AS code FROM lineitem) c2 ON c2.o = x.episode_id
    JOIN (VALUES {", ".join(map(str, charlson_rows()))}) m2(prefix, condition, weight)
      ON starts_with(c2.code, m2.prefix) AND m2.condition = h.worse
    WHERE h.mild = x.condition)
  GROUP BY episode_id) s ON s.episode_id = e.episode_id"""

_EXCLUDED = ", ".join(map(str, range(20, 2000, 60)))

_STAY = "(SELECT person_id, stay_seq, count(*) AS n, max(trans_seq) AS t FROM stays GROUP BY ALL)"
_PERSON = "(SELECT person_id, count(*) AS n, max(person_seq) AS m FROM stays GROUP BY ALL)"
_RULES = [
    ("person_seq_gap", _PERSON, "m <> n"),
    ("hip_seq_gap", "(SELECT person_id, max(hip_seq) AS m, count(*) FILTER (WHERE hip_flag = 1) AS n FROM stays GROUP BY ALL)", "m <> n"),
    ("stay_seq_gap", "(SELECT person_id, max(stay_seq) AS m, count(DISTINCT stay_seq) AS n FROM stays GROUP BY ALL)", "m <> n"),
    ("trans_seq_gap", _STAY, "t <> n - 1"),
    ("stay_totals", "(SELECT person_id, stay_seq, min(stay_size) AS m, count(*) AS n FROM stays GROUP BY ALL)", "m <> n"),
    ("negative_stay", "(SELECT person_id, stay_seq, max(end_date) < min(start_date) AS bad FROM stays GROUP BY ALL)", "bad"),
    ("overlapping_stays", "(SELECT *, lag(sep) OVER (PARTITION BY person_id ORDER BY stay_seq) AS before FROM (SELECT person_id, "
     "stay_seq, min(start_date) AS adm, max(end_date) AS sep FROM stays GROUP BY ALL))", "adm < before"),
]

FINAL: dict[str, str] = {
    "ingest_rejects": """
SELECT reason, CAST(n_fields AS INTEGER) AS n_fields, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT line) AS BIGINT) AS n_distinct
FROM (
  -- a repeated episode stands twice, its dates in two layouts
  SELECT 'too few fields' AS reason, 6 AS n_fields, episode_id || c AS line FROM (SELECT DISTINCT episode_id FROM dirty) JOIN (VALUES ('a'), ('b')) t(c)
    ON c = 'a' OR episode_id % 17 = 0 WHERE episode_id % 19 = 0
  UNION ALL
  SELECT 'too many fields', 8, episode_id || c FROM (SELECT DISTINCT episode_id FROM dirty) JOIN (VALUES ('a'), ('b')) t(c)
    ON c = 'a' OR episode_id % 17 = 0 WHERE episode_id % 23 = 0)
GROUP BY ALL""",
    "stay_violations": " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(count(*) AS BIGINT) AS n_checked, CAST(count(*) FILTER (WHERE {bad}) AS BIGINT) AS n_violations FROM {units}"
        for rule, units, bad in _RULES
    ),
    "price_quantiles": f"""
SELECT l_returnflag, CAST(count(l_extendedprice) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_extendedprice IS NULL) AS BIGINT) AS n_missing,
       {_r('avg(l_extendedprice)', 'mean')}, {_r('stddev_samp(l_extendedprice)', 'sd')}, {_r('min(l_extendedprice)', 'min')},
       {_r('quantile_cont(l_extendedprice, 0.25)', 'q1')}, {_r('quantile_cont(l_extendedprice, 0.5)', 'median')},
       {_r('quantile_cont(l_extendedprice, 0.75)', 'q3')}, {_r('max(l_extendedprice)', 'max')}
FROM lineitem GROUP BY l_returnflag""",
    "price_box": f"""
SELECT l_returnflag, n, {_r('q1', 'q1')}, {_r('median', 'median')}, {_r('q3', 'q3')},
       {_r('min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_low')},
       {_r('max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_high')},
       CAST(count(*) FILTER (WHERE NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL) JOIN (
  SELECT l_returnflag, CAST(count(l_extendedprice) AS BIGINT) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
         quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag) q USING (l_returnflag)
GROUP BY l_returnflag, n, q1, median, q3""",
    "persons_by_span": """
SELECT f.y AS from_year, t.y AS to_year, age_flag, CAST(count(DISTINCT person_id) AS BIGINT) AS n_persons, true AS within
FROM (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS y) f JOIN (SELECT CAST(unnest(range(1996, 2001)) AS INTEGER) AS y) t ON f.y <= t.y
JOIN flagged ON year(start_date) BETWEEN f.y AND t.y GROUP BY ALL""",
    "next_admission_each_stay": """
SELECT s.person_id, s.stay_seq, s.sepdate_last, a.start_date AS next_admission_date,
       CAST(date_diff('day', s.sepdate_last, a.start_date) AS INTEGER) AS days_to_next
FROM (SELECT person_id, stay_seq, sepdate_last FROM stays WHERE trans_seq = 0) s
ASOF LEFT JOIN (SELECT DISTINCT person_id, start_date FROM stays) a ON a.person_id = s.person_id AND a.start_date > s.sepdate_last""",
    "event_gaps": "SELECT event_id, event_type, event, gap FROM gaps",
    "km_event_gaps": f"""
SELECT event_type, gap, n_risk, n_event, CAST(m - n_event AS BIGINT) AS n_censor, {_r('surv', 'surv')},
       {_r('CASE WHEN zero = 0 THEN sqrt(h) END', 'se_log_surv')},
       {_r('CASE WHEN zero = 0 THEN exp(ln(surv) - 1.959963984540054 * sqrt(h)) END', 'lower')},
       {_r('CASE WHEN zero = 0 THEN least(1.0, exp(ln(surv) + 1.959963984540054 * sqrt(h))) END', 'upper')}, CAST(0 AS BIGINT) AS n_excluded
FROM gkm2""",
    "survival_excluded": """
SELECT cci_label, CAST(count(*) AS BIGINT) AS n_subjects, CAST(count(*) FILTER (WHERE time_to_next IS NULL) AS BIGINT) AS n_missing_time,
       CAST(count(*) FILTER (WHERE time_to_next < 0) AS BIGINT) AS n_negative_time,
       CAST(count(*) FILTER (WHERE time_to_next >= 0 AND event IS NULL) AS BIGINT) AS n_missing_event,
       CAST(count(*) FILTER (WHERE cci_label IS NULL OR time_to_next IS NULL OR time_to_next < 0 OR event IS NULL) AS BIGINT) AS n_excluded
FROM scored GROUP BY cci_label""",
    "ingest_csv_dirty": "SELECT * REPLACE (CAST(person_id AS VARCHAR) AS person_id, CAST(episode_id AS VARCHAR) AS episode_id) "
    "FROM dirty_ep",
    "ingest_report_dirty": f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicate,
       CAST(count(*) FILTER (WHERE person_id IS NULL) AS BIGINT) AS n_missing_person,
       CAST(count(*) FILTER (WHERE start_date IS NULL) AS BIGINT) AS n_missing_start,
       CAST(count(*) FILTER (WHERE end_date IS NULL) AS BIGINT) AS n_missing_end,
       CAST(count(*) FILTER (WHERE start_date IS NOT NULL AND end_date IS NOT NULL
            AND NOT (start_date >= {PERIOD_START} AND end_date <= {PERIOD_END})) AS BIGINT) AS n_outside_period,
       CAST(count(*) FILTER (WHERE start_date >= {PERIOD_START} AND end_date <= {PERIOD_END}
            AND person_id IS NOT NULL) AS BIGINT) AS n_kept
FROM (SELECT *, count(*) AS c FROM dirty GROUP BY ALL)""",
    "profile_dirty": _PROFILE.replace("FROM fx_episode", "FROM dirty"),
    "duplicate_report_dirty": _dup("dirty", "fx_episode_dirty"),
    "flag_table_dirty": """
SELECT age_flag, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS percent,
       round(CASE WHEN age_flag IS NOT NULL THEN CAST(count(*) AS DOUBLE)
             / sum(CASE WHEN age_flag IS NOT NULL THEN count(*) END) OVER () END, 6) AS valid_percent
FROM dirty_flagged GROUP BY age_flag""",
    "mode_crosstab_dirty": """
SELECT hip_flag,
       CAST(count(*) FILTER (WHERE mode = 'F') AS BIGINT) AS "F",
       CAST(count(*) FILTER (WHERE mode = 'O') AS BIGINT) AS "O",
       CAST(count(*) FILTER (WHERE mode = 'P') AS BIGINT) AS "P",
       CAST(count(*) FILTER (WHERE mode IS NOT NULL AND mode NOT IN ('F', 'O', 'P')) AS BIGINT) AS other,
       CAST(count(*) FILTER (WHERE mode IS NULL) AS BIGINT) AS "NA"
FROM dirty_flagged GROUP BY hip_flag""",
    "date_layouts": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dmy, CAST(o_orderdate AS DATE) AS ymd FROM orders",
    "episode_sequences_hot": "SELECT person_id, episode_id, start_date, end_date, age_flag, hip_flag, file_seq, "
    "person_seq, hip_cumcount, post_index, index_seq, hip_seq FROM hot_seq",
    "transfer_stays_hot": "SELECT * FROM hot_stays",
    "los_box_by_mode": _MODE_BOX,
    "summary_median": f"""
SELECT 'length of stay' AS variable, CAST(count(totlos) AS BIGINT) AS n,
       {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.5)', 'median')}, {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.25)', 'q1')},
       {_r('quantile_cont(CAST(totlos AS DOUBLE), 0.75)', 'q3')}
FROM first_los""",
    "resolved_deaths_excluded": f"""
SELECT p.person_id, CASE WHEN p.person_id NOT IN ({_EXCLUDED}) THEN r.death_date END AS death_date,
       CASE WHEN p.person_id NOT IN ({_EXCLUDED}) THEN r.age_death END AS age_death,
       CASE WHEN p.person_id IN ({_EXCLUDED}) THEN 'excluded'
            WHEN r.person_id IS NULL THEN 'no record before the last episode' END AS drop_reason
FROM per_person p LEFT JOIN resolved r ON r.person_id = p.person_id""",
    "charlson_score": _CHARLSON,
    "ingest_clean": "SELECT * FROM ep",
    "ingest_report": f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicate,
       CAST(count(*) FILTER (WHERE person_id IS NULL) AS BIGINT) AS n_missing_person,
       CAST(count(*) FILTER (WHERE start_date IS NULL) AS BIGINT) AS n_missing_start,
       CAST(count(*) FILTER (WHERE end_date IS NULL) AS BIGINT) AS n_missing_end,
       CAST(count(*) FILTER (WHERE start_date IS NOT NULL AND end_date IS NOT NULL
            AND NOT (start_date >= {PERIOD_START} AND end_date <= {PERIOD_END})) AS BIGINT) AS n_outside_period,
       CAST(count(*) FILTER (WHERE start_date >= {PERIOD_START} AND end_date <= {PERIOD_END}
            AND person_id IS NOT NULL) AS BIGINT) AS n_kept
FROM (SELECT *, count(*) AS c FROM fx_episode GROUP BY ALL)""",
    "duplicate_report": " UNION ALL ".join(
        [_dup("fx_episode", "fx_episode"), _dup("fx_death", "fx_death"), _dup("fx_diagnosis", "fx_diagnosis")]
    ),
    "profile": _PROFILE,
    "flag_table": _freq("flagged", "age_flag"),
    "episode_sequences": "SELECT person_id, episode_id, start_date, end_date, age_flag, hip_flag, file_seq, "
    "person_seq, hip_cumcount, post_index, index_seq, hip_seq FROM seq",
    "file_sequence": "SELECT person_id, episode_id, file_seq FROM seq1",
    "cohort": "SELECT person_id, episode_id, age, age_flag, hip_flag, person_seq, hip_seq FROM cohort",
    "cohort_size": "SELECT CAST(count(DISTINCT person_id) AS BIGINT) AS n_persons, "
    "CAST(count(*) AS BIGINT) AS n_episodes FROM cohort",
    "first_by_year": _freq("(SELECT CAST(year(start_date) AS INTEGER) AS year FROM cohort WHERE hip_seq = 1)", "year"),
    "multi_death": "SELECT * FROM deaths WHERE person_id IN "
    "(SELECT person_id FROM deaths GROUP BY person_id HAVING count(*) > 1)",
    "death_vs_episodes": "SELECT * FROM dve",
    "resolved_deaths": "SELECT * FROM resolved",
    "dropped_persons": "SELECT * FROM dropped",
    "linked": "SELECT person_id, episode_id, start_date, end_date, hip_seq, death_date, age_death FROM linked",
    "linked_size": "SELECT CAST(count(DISTINCT person_id) AS BIGINT) AS n_persons, "
    "CAST(count(*) AS BIGINT) AS n_episodes FROM linked",
    "transfer_stays": "SELECT person_id, episode_id, start_date, end_date, mode, stay_seq, trans_seq, stay_size, "
    "admdate_first, sepdate_last, totlos FROM stays",
    "stay_episode_freq": _freq("(SELECT trans_seq FROM stays WHERE hip_seq = 1)", "trans_seq"),
    "stay_size_freq": _freq("(SELECT stay_size FROM stays WHERE hip_seq = 1)", "stay_size"),
    "longest_chain": "SELECT person_id, trans_seq, stay_size FROM stays WHERE hip_seq = 1 AND trans_seq = "
    "(SELECT max(trans_seq) FROM stays WHERE hip_seq = 1)",
    "flagged_stays": "SELECT person_id, episode_id, stay_seq, trans_seq, hip_flag, hip_seq, hf_stays_all FROM hip_stays",
    "stays_per_person": _level_summary(
        "(SELECT person_id, max(hip_seq) AS hip_seq FROM hip_stays WHERE hip_flag = 1 GROUP BY person_id)",
        "hip_seq",
        "hip admissions ignoring transfers",
    )
    + " UNION ALL "
    + _level_summary(
        "(SELECT person_id, max(hf_stays_all) AS hf_stays_all FROM hip_stays WHERE hip_flag = 1 GROUP BY person_id)",
        "hf_stays_all",
        "hip admissions accounting for transfers",
    ),
    "mode_crosstab": """
SELECT hip_seq,
       CAST(count(*) FILTER (WHERE mode = 'F') AS BIGINT) AS "F",
       CAST(count(*) FILTER (WHERE mode = 'O') AS BIGINT) AS "O",
       CAST(count(*) FILTER (WHERE mode = 'P') AS BIGINT) AS "P",
       CAST(count(*) FILTER (WHERE mode IS NOT NULL AND mode NOT IN ('F', 'O', 'P')) AS BIGINT) AS other,
       CAST(count(*) FILTER (WHERE mode IS NULL) AS BIGINT) AS "NA"
FROM stays GROUP BY hip_seq""",
    "mode_summary": _summary_by("hip_seq", "hip admissions ignoring transfers")
    + " UNION ALL "
    + _summary_by("hf_stays_all", "hip admissions accounting for transfers"),
    "los_stats": _describe("first_los"),
    "los_stats_trimmed": _describe(f"(SELECT * FROM first_los WHERE person_id NOT IN {_TOP5})"),
    "los_histogram": "SELECT CAST(ceil(totlos / 1.0 - 0.5) * 1.0 AS DOUBLE) AS bin, CAST(count(*) AS BIGINT) AS n "
    "FROM first_los WHERE totlos IS NOT NULL GROUP BY 1",
    "los_box": _LOS_BOX,
    "longest_stays": "SELECT person_id, hip_seq, totlos FROM first_los WHERE totlos IS NOT NULL "
    "ORDER BY totlos DESC, person_id LIMIT 5",
    "next_admission": "SELECT person_id, episode_id, discharge_date, next_admission_date FROM readm",
    "censoring": "SELECT person_id, event, death_date, censor_date, followup_end, time_to_next FROM cens",
    "negative_times": "SELECT CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(*) FILTER (WHERE time_to_next < 0) AS BIGINT) AS n_negative, "
    "CAST(count(*) FILTER (WHERE time_to_next IS NULL) AS BIGINT) AS n_missing FROM cens",
    "comorbidity_group": "SELECT person_id, episode_id, cci_score, ccicat, cci_group, cci_label, cci_rank FROM scored",
    "outcome_table": """
SELECT cci_group, CAST(count(*) AS BIGINT) AS total_patients,
       CAST(count(*) FILTER (WHERE event = 1) AS BIGINT) AS readmitted,
       CAST(count(*) FILTER (WHERE event = 0 AND death_date IS NOT NULL AND death_date <= DATE '2000-12-31')
            AS BIGINT) AS censored_death,
       CAST(count(*) FILTER (WHERE event = 0 AND (death_date IS NULL OR death_date > DATE '2000-12-31'))
            AS BIGINT) AS censored_end,
       round(count(*) FILTER (WHERE event = 1) * 100.0 / count(*), 6) AS readmitted_prop
FROM scored GROUP BY cci_group""",
    "km_curve": f"""
SELECT cci_label, time_to_next, n_risk, n_event, n_censor, {_r('surv', 'surv')}, {_r('se_log_surv', 'se_log_surv')},
       {_r('lower', 'lower')}, {_r('upper', 'upper')},
       CAST((SELECT count(*) FROM scored s WHERE s.cci_label = km.cci_label AND {_UNUSED}) AS BIGINT) AS n_excluded
FROM km""",
    "km_at_times": _KM_AT,
    "km_median": "SELECT cci_label, min(time_to_next) FILTER (WHERE surv <= 0.5 + 1e-9) AS median_time "
    "FROM km GROUP BY cci_label",
    "logrank": _LOGRANK,
    "logrank_test": _LOGRANK_TEST,
}


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + sql for name, sql in FINAL.items()}
