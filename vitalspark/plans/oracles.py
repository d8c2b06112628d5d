"""DuckDB SQL for the queries of the catalogue, written from the operators' definitions."""

from __future__ import annotations

from vitalspark.functions import drugs, registries
from vitalspark.operators import notes

PATIENTS = """
pat AS (SELECT o_custkey AS pid, min(o_orderdate)::DATE AS idx, max(o_orderdate)::DATE AS last, arg_max(o_orderstatus, (o_orderdate::DATE, o_orderkey)) AS status FROM orders GROUP BY o_custkey),
surv AS (SELECT pid, idx, last, date_diff('day', idx, last) AS os_days, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS event, c_mktsegment AS seg, c_nationkey AS nation FROM pat JOIN customer ON c_custkey = pid)"""

ADMINS = """
ship AS (SELECT l_orderkey, max(l_shipdate)::DATE AS ship FROM lineitem GROUP BY l_orderkey),
adm AS (SELECT o_custkey AS pid, lower(trim(o_orderpriority)) AS drug, o_orderdate::DATE AS st, greatest(coalesce(ship, o_orderdate::DATE), o_orderdate::DATE) AS en FROM orders LEFT JOIN ship ON o_orderkey = l_orderkey),
prog AS (SELECT DISTINCT o_custkey AS pid, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus = 'P')"""


def episodes(admins: str = "adm") -> str:
    return f"""
isl AS (SELECT *, sum(CASE WHEN date_diff('day', reached, st) > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY pid, drug ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, max(en) OVER (PARTITION BY pid, drug ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {admins})),
epi AS (SELECT pid, drug, min(st) AS st, max(en) AS en, count(*) AS n FROM isl GROUP BY pid, drug, i),
rnk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY st, drug) AS rn FROM epi),
fold AS (
  SELECT pid, rn, drug, st, en, 1 AS line, st AS lst, en AS len_, [drug] AS ds FROM rnk WHERE rn = 1
  UNION ALL
  SELECT pid, rn, drug, st, en, CASE WHEN brk THEN line + 1 ELSE line END, CASE WHEN brk THEN st ELSE lst END, CASE WHEN brk THEN en ELSE greatest(len_, en) END, CASE WHEN brk THEN [drug] ELSE list_append(ds, drug) END
  FROM (SELECT r.pid, r.rn, r.drug, r.st, r.en, f.line, f.lst, f.len_, f.ds,
      list_contains(f.ds, r.drug) OR EXISTS (SELECT 1 FROM prog p WHERE p.pid = r.pid AND p.d BETWEEN f.lst AND r.st) OR NOT (date_diff('day', f.lst, r.st) <= 28 OR date_diff('day', f.len_, r.st) <= 28) AS brk
    FROM fold f JOIN rnk r ON r.pid = f.pid AND r.rn = f.rn + 1))"""


LINES = """
ln AS (SELECT pid, line, min(st) AS st, max(en) AS en, string_agg(drug, ',' ORDER BY st, drug) AS drugs, string_agg(drug, ' + ' ORDER BY st, drug) AS label, list_reverse_sort(list(en)) AS ends FROM fold GROUP BY pid, line),
nx AS (SELECT *, lead(st) OVER (PARTITION BY pid ORDER BY line) AS nxt FROM ln),
fin AS (SELECT nx.*, CASE WHEN nxt IS NULL AND status = 'F' AND abs(date_diff('day', nx.en, pat.last)) <= 90 THEN 'death'
    WHEN nxt IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM prog p WHERE p.pid = nx.pid AND p.d BETWEEN nx.en AND nx.nxt) THEN 'progression' ELSE 'completion' END ELSE 'unknown' END AS reason,
  len(ends) > 1 AND date_diff('day', ends[2], ends[1]) >= 42 AS maint FROM nx JOIN pat ON pat.pid = nx.pid)"""


def km(strata: str = "") -> str:
    """CTE km(strata, time, n_risk, n_event, survival, greenwood)."""
    part = f"PARTITION BY {strata}" if strata else ""
    s = f"{strata}, " if strata else ""
    return f"""
g AS (SELECT {s}os_days AS time, count(*) AS leaving, sum(event) AS n_event FROM surv GROUP BY {s}os_days),
r AS (SELECT *, sum(leaving) OVER ({part}) - coalesce(sum(leaving) OVER ({part} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_risk FROM g),
km AS (SELECT {s}time, n_risk, n_event, product(1 - n_event / n_risk) OVER ({part} ORDER BY time ROWS UNBOUNDED PRECEDING) AS survival,
  sum(CASE WHEN n_event > 0 AND n_risk > n_event THEN n_event / (n_risk * (n_risk - n_event)) ELSE 0 END) OVER ({part} ORDER BY time ROWS UNBOUNDED PRECEDING) AS greenwood FROM r),
band AS (SELECT *, CASE WHEN survival < 1 AND survival > 0 AND greenwood > 0 THEN pow(survival, exp(1.959963984540054 * sqrt(greenwood) / ln(survival))) ELSE survival END AS one,
  CASE WHEN survival < 1 AND survival > 0 AND greenwood > 0 THEN pow(survival, exp(-1.959963984540054 * sqrt(greenwood) / ln(survival))) ELSE survival END AS two FROM km)"""


MEDIAN = "CAST(min(time) FILTER (survival <= 0.5) AS INTEGER) AS median, CAST(min(time) FILTER (least(one, two) <= 0.5) AS INTEGER) AS ci_lower, CAST(min(time) FILTER (greatest(one, two) <= 0.5) AS INTEGER) AS ci_upper"
SUMMARY = """(SELECT count(*) FROM pat JOIN customer ON c_custkey = pid) AS n_patients, count(*) AS n_treated, round_even(100.0 * count(*) FILTER (m >= 2) / greatest(count(*), 1), 1) AS pct_reaching_line_2,
  round_even(100.0 * count(*) FILTER (m >= 3) / greatest(count(*), 1), 1) AS pct_reaching_line_3"""
PLOT = "plt AS (SELECT pid, seg, greatest(os_days / 30.44, 0) AS months, event FROM surv)"
DECISIONS = """dec AS (SELECT user_id AS pkey, event_type AS source_column, CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'llm' WHEN 'purchase' THEN 'normalizer' WHEN 'signup' THEN 'haiku' ELSE 'operator' END AS decided_by,
  CASE event_type WHEN 'signup' THEN 'append' WHEN 'error' THEN 'unclear' ELSE 'join' END AS verdict, upper(event_type) AS canonical_name, ts AS decided_at, event_id AS id FROM events)"""
SIGNALS = "sig AS (SELECT user_id AS pkey, event_type AS source, ts AS occurred_at, event_id AS id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"
ODD = """odd AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN d WHEN 1 THEN d[:7] WHEN 2 THEN d[:4] WHEN 3 THEN d || 'T10:00:00' WHEN 4 THEN 'unknown' WHEN 5 THEN d[:8] || '32' WHEN 6 THEN '' END AS t
  FROM (SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS d FROM orders))"""


def _pick(values: list[str], by: int = 1) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(floor(i / {by}) % {len(values)} + 1 AS INTEGER)]"


NOTE_TEXT = f"""note AS (SELECT i % 97 AS patient_id, i AS note_order, coalesce(text, '') || chr(10) || 'Advanced ' || {_pick(['adenocarcinoma', 'squamous cell carcinoma', 'lung cancer'])} || ', stage ' || {_pick(['IVA', 'IIIB', 'II'], 2)} || '. ECOG performance status: ' || CAST(i % 6 AS VARCHAR)
  || '. EGFR: ' || {_pick(['positive', 'negative', 'not tested'], 3)} || '; ALK negative. ' || {_pick(['exon 19 deletion', 'L858R', 'KRAS G12C seen'], 5)} || '. PD-L1: ' || {_pick(['high', 'low', 'n/a'], 7)} || ' (TPS ' || CAST(i % 100 AS VARCHAR) || '.5%). '
  || {_pick(['progression documented on 2021-03-04 with new involvement at: bone, liver', 'stable disease'], 4)} || '. Given ' || {_pick(['carboplatin and pemetrexed', 'nab-paclitaxel', 'osimertinib'], 11)} || '.' AS text FROM (SELECT doc_id AS i, text FROM documents))"""


def _found(words: list[str], spaced: bool = False) -> str:
    """Words inside l, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN contains(l, '{w.replace('_', ' ') if spaced else w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}', 1), '')"


def _status(gene: str) -> str:
    return f"replace(lower(regexp_extract_all(text, '{notes.STATUS.format(gene.upper())}', 1)[-1]), ' ', '_')"


ABSTRACT = f"""abs_ AS (SELECT patient_id, note_order, ({_found(notes.HISTOLOGIES, True)})[1] AS histology, upper({_first(notes.STAGE)}) AS stage, {_status('egfr')} AS egfr_status,
  CASE WHEN contains(l, 'exon 19') OR contains(l, 'exon19') THEN 'exon19_deletion' WHEN contains(l, 'l858r') THEN 'L858R' END AS egfr_mutation,
  {_status('alk')} AS alk_status, {_status('ros1')} AS ros1_status, {_status('kras')} AS kras_status, {_first(chr(92) + 'b(G12[A-Z])' + chr(92) + 'b')} AS kras_variant, {_status('braf')} AS braf_status,
  lower({_first(notes.PDL1)}) AS pdl1_status, try_cast({_first(notes.TPS)} AS DOUBLE) AS pdl1_tps, try_cast({_first(notes.ECOG)} AS INTEGER) AS ecog, contains(l, 'progression') AS progression_mentioned, {_first(notes.PROGRESSED)} AS progression_date,
  CASE WHEN contains(l, 'progression') OR contains(l, 'new involvement at') THEN {_found(notes.SITES)} ELSE [] END AS new_metastatic_sites, {_found(notes.TREATMENTS)} AS treatments_mentioned
  FROM (SELECT *, lower(text) AS l FROM note))"""
_SCALAR = [c for c in notes.SCALARS if c != "progression_mentioned"]
MERGED = (
    "mrg AS (SELECT patient_id, "
    + ", ".join(f"arg_min({c}, note_order) FILTER ({c} IS NOT NULL) AS {c}" for c in [*_SCALAR, "pdl1_tps"])
    + ", bool_or(progression_mentioned) AS progression_mentioned, list_sort(list_distinct(flatten(list(new_metastatic_sites)))) AS new_metastatic_sites FROM abs_ GROUP BY patient_id),"
    + " trt AS (SELECT patient_id, string_agg(t, ',' ORDER BY first) AS treatments_mentioned, list(t) AS ts FROM (SELECT patient_id, t, min(note_order * 100 + p) AS first FROM (SELECT patient_id, note_order, unnest(treatments_mentioned) AS t, generate_subscripts(treatments_mentioned, 1) AS p FROM abs_) GROUP BY patient_id, t) GROUP BY patient_id)"
)
TRUTH = "fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY note_order) AS rn FROM abs_) WHERE rn = 1)"
_PLAIN = "nullif(replace(lower(trim(CAST({} AS VARCHAR))), ' ', '_'), '')"
PAIRS = "prs AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {_PLAIN.format('t.' + f)} AS t, {_PLAIN.format('p.' + f)} AS p FROM fst t JOIN mrg p ON t.patient_id = p.patient_id" for f in notes.SCALARS) + ")"
SETS = """sts AS (SELECT 'new_metastatic_sites' AS field, t.new_metastatic_sites AS t, p.new_metastatic_sites AS p FROM fst t JOIN mrg p ON t.patient_id = p.patient_id
  UNION ALL SELECT 'treatments_mentioned', t.treatments_mentioned, coalesce(x.ts, []) FROM fst t LEFT JOIN trt x ON t.patient_id = x.patient_id),
sms AS (SELECT field, sum(len(list_intersect(t, p))) AS tp, sum(len(list_filter(p, lambda x: NOT list_contains(t, x)))) AS fp, sum(len(list_filter(t, lambda x: NOT list_contains(p, x)))) AS fn FROM sts GROUP BY field),
prf AS (SELECT field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM sms),
f1s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM prf)"""
SCORES = "scs AS (SELECT field, count(*) AS n, avg(CASE WHEN t IS NOT DISTINCT FROM p THEN 1.0 ELSE 0.0 END) AS accuracy, coalesce(count(*) FILTER (t IS NOT NULL AND p IS NULL) / nullif(count(t), 0), 0.0) AS miss_rate FROM prs GROUP BY field)"

_FORMULAS = ["v * 0.001", "v * 0.45359237", "(v - 32) * 5 / 9", "v * 0.0555", "v * 88.4", "v * 0.0254 / 0.01", "NULL", "NULL", "v * 0.001", "v * 9 / 5 + 32"]
_ERRORS = [None] * 6 + ["no conversion", "unknown unit", None, None]
_CANONICAL = ["g", "kg", None, "mg/dL", "mg/dL", "m", "mg/dL", None, "L", None]


def _case(values: list[str | None]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"


_ALIASES = ", ".join(f"('{a.replace('-', '_').replace(' ', '_')}', '{x[0]}')" for x in registries.LOINC for a in x[4])
_KEYS = ", ".join(f"('{k}', '{x[1]}', '{x[2]}')" for x in registries.RXNORM for k in (x[0], x[1], x[3].lower()))
_ONCOLOGY = "[" + ", ".join(f"'{d}'" for d in drugs.ONCOLOGY) + "]"
_CLASSES = ", ".join(f"('{d}', '{c}')" for c, names in (("tki", drugs.TKI), ("io", drugs.IO), ("chemo", drugs.CHEMO)) for d in names)

SQL: dict[str, str] = {
    "rwos_records": f"WITH {PATIENTS} SELECT pid AS patient_id, idx AS index_date, last AS event_date, CAST(os_days AS INTEGER) AS os_days, event, CASE WHEN event = 1 THEN 'deceased' ELSE 'alive' END AS vital_status, 'day' AS index_date_precision, false AS index_date_assumed, CAST(20 + pid % 60 AS INTEGER) AS age_at_index FROM surv",
    "rwos_months": f"WITH {PATIENTS} SELECT pid AS patient_id, CAST(os_days AS INTEGER) AS os_days, round(os_days / 30.4375, 2) AS rwos_months, event, event = 1 AS event_observed FROM surv",
    "rwos_plot_months": f"WITH {PATIENTS}, {PLOT} SELECT pid AS patient_id, round(months, 6) AS months, event FROM plt",
    "km_overall": f"WITH {PATIENTS}, {km()} SELECT CAST(time AS INTEGER) AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event, round(survival, 9) AS survival, round(greenwood, 12) AS greenwood FROM km",
    "km_median_ci": f"WITH {PATIENTS}, {km()} SELECT {MEDIAN} FROM band",
    "km_by_segment": f"WITH {PATIENTS}, {km('seg')} SELECT seg AS c_mktsegment, CAST(time AS INTEGER) AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event, round(survival, 9) AS survival FROM km UNION ALL SELECT seg, 0, CAST(max(n_risk) AS BIGINT), 0, 1.0 FROM km GROUP BY seg",
    "km_segment_medians": f"WITH {PATIENTS}, {km('seg')} SELECT seg AS c_mktsegment, {MEDIAN} FROM band GROUP BY seg",
    "km_greenwood_at": f"WITH {PATIENTS}, {km('seg')} SELECT seg AS c_mktsegment, round(greatest(coalesce(arg_max(survival * survival * greenwood, time) FILTER (time <= 1500), 0), 0), 12) AS variance FROM km GROUP BY seg",
    "at_risk_table": f"WITH {PATIENTS}, {PLOT} SELECT seg AS c_mktsegment, m AS month, count(*) FILTER (months >= m) AS n_risk FROM plt, (SELECT unnest([0, 6, 12, 18, 24, 36, 48]) AS m) GROUP BY seg, m",
    "followup_median": f"WITH {PATIENTS} SELECT seg AS c_mktsegment, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, count(*) FILTER (event = 0) AS n_censored, CAST(median(os_days) AS DOUBLE) AS median_days FROM surv GROUP BY seg",
    "episodes_gap_islands": f"WITH RECURSIVE {ADMINS}, {episodes()} SELECT pid AS patient_id, drug, st AS start, en AS \"end\", n AS n_admins FROM epi",
    "lot_greedy": f"WITH RECURSIVE {ADMINS}, {episodes()} SELECT pid AS patient_id, drug, st AS start, en AS \"end\", line FROM fold",
    "lot_lines": f"WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, {LINES} SELECT pid AS patient_id, line AS line_number, drugs, st AS start_date, en AS end_date, reason AS end_reason, maint AS is_maintenance, label AS regimen_label, 'chemo' AS drug_class FROM fin",
    "lot_sql_mart": f"""WITH {ADMINS},
ord AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY st, drug, en) AS rn FROM adm),
lag_ AS (SELECT *, lag(st) OVER (PARTITION BY pid ORDER BY rn) AS prev, st = min(st) OVER (PARTITION BY pid, drug) AS fresh FROM ord),
flag AS (SELECT *, EXISTS (SELECT 1 FROM prog p WHERE p.pid = lag_.pid AND p.d <= lag_.st AND p.d > coalesce(lag_.prev, DATE '1900-01-01')) AS progressed FROM lag_),
num AS (SELECT *, sum(CASE WHEN prev IS NULL OR (fresh AND (progressed OR date_diff('day', prev, st) > 90)) THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY rn ROWS UNBOUNDED PRECEDING) AS line FROM flag)
SELECT pid AS patient_id, CAST(line AS BIGINT) AS line_number, min(st) AS line_start_date, max(en) AS line_end_date, string_agg(DISTINCT drug, ',' ORDER BY drug) AS drugs, count(*) AS n_administrations FROM num GROUP BY pid, line""",
    "lot_summary": f"WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, per AS (SELECT pid, max(line) AS m FROM fold GROUP BY pid) SELECT {SUMMARY} FROM per",
    "derived_pipeline": f"WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, {km()}, per AS (SELECT pid, max(line) AS m FROM fold GROUP BY pid), sm AS (SELECT {SUMMARY} FROM per), md AS (SELECT {MEDIAN} FROM band) SELECT * FROM sm, md",
    "lot_validate": f"""WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, {LINES}
SELECT code, count(*) AS n FROM (SELECT 'treatment_before_diagnosis' AS code FROM fin JOIN pat ON pat.pid = fin.pid WHERE line = 1 AND st < idx + 1 UNION ALL SELECT 'unrecognized_drug' FROM fold
  UNION ALL SELECT 'implausible_duration' FROM fin WHERE date_diff('day', st, en) > 3650) GROUP BY code""",
    "lot_first_line_class": f"""WITH RECURSIVE {ADMINS}, named AS (SELECT pid, ({_ONCOLOGY})[ascii(drug) * 7 % {len(drugs.ONCOLOGY)} + 1] AS drug, st, en FROM adm), {episodes("named")}, cls(drug, c) AS (VALUES {_CLASSES}),
one AS (SELECT pid, bool_or(c = 'tki') AS t, bool_or(c = 'io') AS i, bool_or(c = 'chemo') AS k FROM fold JOIN cls ON fold.drug = cls.drug WHERE line = 1 GROUP BY pid)
SELECT CASE WHEN t AND i THEN 'tki+io' WHEN t AND k THEN 'tki+chemo' WHEN k AND i THEN 'chemo+io' WHEN t THEN 'tki' WHEN i THEN 'io' ELSE 'chemo' END AS drug_class, count(*) AS n FROM one GROUP BY 1""",
    "new_drug_not_in": f"""WITH {ADMINS}, u AS (SELECT pid, drug, st, count(*) AS n FROM adm GROUP BY pid, drug, st)
SELECT pid AS patient_id, drug, st AS start, n, CASE WHEN drug NOT IN (SELECT b.drug FROM adm b WHERE b.pid = u.pid AND b.st < u.st) THEN 1 ELSE 0 END AS is_new FROM u""",
    "progressed_exists": f"WITH {ADMINS} SELECT DISTINCT pid AS patient_id, st AS start FROM adm a WHERE EXISTS (SELECT 1 FROM prog p WHERE p.pid = a.pid AND p.d <= a.st AND date_diff('day', p.d, a.st) < 90)",
    "nearest_within_30d": f"""WITH {ADMINS}, l AS (SELECT o_custkey AS pid, o_orderdate::DATE AS d, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
c AS (SELECT l.*, a.en, a.drug, row_number() OVER (PARTITION BY l.pid, l.d ORDER BY abs(date_diff('day', l.d, a.en)), a.en, a.drug) AS rn FROM l LEFT JOIN adm a ON a.pid = l.pid AND abs(date_diff('day', l.d, a.en)) <= 30)
SELECT pid AS patient_id, d AS date, n, en AS dose_end, drug FROM c WHERE rn = 1""",
    "anti_never_ordered": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "latest_decision": f"WITH {DECISIONS} SELECT pkey, source_column, id, decided_by, verdict FROM (SELECT *, row_number() OVER (PARTITION BY pkey, source_column ORDER BY decided_at DESC, id DESC) AS rn FROM dec) WHERE rn = 1",
    "decision_history": f"WITH {DECISIONS} SELECT pkey, source_column, id, decided_by, CAST(row_number() OVER (PARTITION BY pkey, source_column ORDER BY decided_at DESC, id DESC) AS INTEGER) AS place FROM dec",
    "decision_cache": f"WITH {DECISIONS}, old AS (SELECT pkey, source_column, arg_max(id, (decided_at, id)) AS cached_id FROM dec WHERE decided_at < '2024-01-22' GROUP BY 1, 2) SELECT n.pkey, n.source_column, old.cached_id FROM (SELECT DISTINCT pkey, source_column FROM dec WHERE decided_at >= '2024-01-22') n LEFT JOIN old ON n.pkey = old.pkey AND n.source_column = old.source_column",
    "signal_upsert": f"WITH {SIGNALS} SELECT pkey, source, max(id) AS id, arg_max(k, id) AS k FROM sig GROUP BY pkey, source",
    "schema_upsert": f"WITH {DECISIONS} SELECT pkey, canonical_name, max(id) AS id, min(id) AS first_seen FROM dec GROUP BY pkey, canonical_name",
    "merged_record": f"""WITH {SIGNALS}, v AS (SELECT pkey, source, occurred_at, id, 'k' AS canonical_name, CAST(k AS VARCHAR) AS value FROM sig UNION ALL SELECT pkey, source, occurred_at, id, source, printf('%.2f', value) FROM sig)
SELECT pkey, canonical_name, arg_max(value, (CAST(occurred_at AS VARCHAR), id)) AS value FROM v WHERE value IS NOT NULL GROUP BY pkey, canonical_name""",
    "value_conflicts": f"WITH {SIGNALS}, o AS (SELECT pkey, source, min(k) AS v FROM sig WHERE k IS NOT NULL GROUP BY 1, 2) SELECT a.pkey, a.source AS source_a, a.v AS value_a, b.source AS source_b, b.v AS value_b FROM o a JOIN o b ON a.pkey = b.pkey AND a.source < b.source AND a.v <> b.v",
    "decisions_per_day": f"WITH {DECISIONS} SELECT decided_at::DATE AS day, decided_by, count(*) AS n FROM dec GROUP BY 1, 2",
    "decision_tallies": f"WITH {DECISIONS} SELECT decided_by AS key, count(*) AS n FROM dec GROUP BY 1 UNION ALL SELECT 'verdict:' || verdict, count(*) FROM dec GROUP BY 1",
    "tier_counts": f"WITH {DECISIONS} SELECT count(*) FILTER (decided_by IN ('lookup', 'normalizer')) AS deterministic, count(*) FILTER (decided_by IN ('haiku', 'llm')) AS model, count(*) FILTER (verdict = 'append') AS appended FROM dec",
    "audit_filter": f"WITH {DECISIONS} SELECT decided_by, verdict, count(*) AS n FROM dec WHERE decided_by IN ('lookup', 'llm') AND verdict = 'join' GROUP BY 1, 2",
    "audit_options": f"WITH {DECISIONS} SELECT DISTINCT decided_by FROM dec",
    "timeline_since": f"WITH {SIGNALS} SELECT pkey, source, id FROM sig WHERE occurred_at >= '2024-01-25'",
    "offline_hold": "SELECT CASE event_type WHEN 'view' THEN 'glucose_mg' WHEN 'click' THEN 'alk_result' WHEN 'purchase' THEN 'drug_name' WHEN 'signup' THEN 'visit_no' ELSE 'performance_status' END AS source_column, CASE WHEN event_type IN ('view', 'click', 'purchase', 'error') THEN count(*) ELSE 0 END AS n, event_type = 'signup' AS held FROM events GROUP BY event_type",
    "code_regex": r"""WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey % 99999 AS VARCHAR) || '-' || CAST(p_size % 10 AS VARCHAR) WHEN 1 THEN 'C' || CAST(p_size + 10 AS VARCHAR) || '.1' ELSE CAST(p_partkey AS VARCHAR) END AS code FROM part)
SELECT p_partkey, regexp_matches(code, '^\d{1,5}-\d$') AS is_loinc, regexp_matches(code, '^[A-Z]\d{2}(\.\d+)?$') AS is_icd10, regexp_matches(code, '^\d{4,7}$') AS is_rxnorm FROM c""",
    "alias_theta_join": f"""WITH a(alias, code) AS (VALUES {_ALIASES}), n AS (SELECT p_partkey, translate(lower(p_name || ' ' || p_type || CASE p_partkey % 5 WHEN 0 THEN ' ALT level' WHEN 1 THEN ' Hgb' ELSE '' END), '- ', '__') AS name FROM part),
h AS (SELECT p_partkey, count(DISTINCT code) AS n, min(code) AS code FROM n JOIN a ON contains(name, alias) GROUP BY p_partkey)
SELECT n.p_partkey, CAST(coalesce(h.n, 0) AS INTEGER) AS n_entries, CASE WHEN h.n = 1 THEN h.code END AS code FROM n LEFT JOIN h ON n.p_partkey = h.p_partkey""",
    "brand_lookup": f"WITH k(key, drug, drug_class) AS (VALUES {_KEYS}), p AS (SELECT p_partkey, lower((['Keytruda', 'OPDIVO', 'cisplatin', '40048', 'Unknownib', 'Alimta'])[CAST(p_partkey % 6 + 1 AS INTEGER)]) AS key FROM part) SELECT p_partkey, p.key, drug, drug_class FROM p LEFT JOIN k ON p.key = k.key",
    "lookup_tiers": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'hemoglobin' WHEN 1 THEN 'diagnosis_code' WHEN 2 THEN 'drug_name' WHEN 3 THEN 'glucose' END AS canonical_name, CASE p_partkey % 6 WHEN 0 THEN 'LOINC' WHEN 1 THEN 'ICD-10' WHEN 2 THEN 'RxNorm' WHEN 3 THEN 'LOINC' END AS registry,
CASE p_partkey % 6 WHEN 0 THEN '718-7' WHEN 1 THEN 'C34.11' WHEN 2 THEN '1547545' WHEN 3 THEN '2345-7' END AS code, CASE p_partkey % 6 WHEN 3 THEN 'column_name' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'sample_value_code' END AS matched_on FROM part""",
    "cohort_filter": f"WITH {PATIENTS} SELECT pid AS patient_id, CAST(20 + pid % 60 AS INTEGER) AS age, seg AS c_mktsegment FROM surv WHERE 20 + pid % 60 BETWEEN 30 AND 55 AND event = 1 AND seg IN ('BUILDING', 'MACHINERY')",
    "cohort_flags": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS seg, c_name, (['IVA', 'IIIB', 'II'])[CAST(c_custkey % 3 + 1 AS INTEGER)] AS stage FROM customer)
SELECT c_custkey, seg IN ('BUILDING', 'FURNITURE') AS inc_histology, c_name IS NOT NULL AS inc_advanced_date, stage IN ('IIIB', 'IIIC', 'IVA', 'IVB') AS inc_stage, false AS exc_other_primary, false AS exc_trial_only, seg IS NOT NULL AND c_name IS NOT NULL AND stage IN ('IIIB', 'IIIC', 'IVA', 'IVB') AS is_eligible FROM c""",
    "value_counts_pct": f"""WITH {PATIENTS}, t AS (SELECT 'seg' AS field, CASE WHEN pid % 7 > 0 THEN seg END AS value FROM surv UNION ALL SELECT 'vital_status', CASE WHEN event = 1 THEN 'deceased' ELSE 'alive' END FROM surv UNION ALL SELECT 'c_nationkey', CAST(nation AS VARCHAR) FROM surv)
SELECT field, value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM surv), 6) AS pct FROM t WHERE value IS NOT NULL GROUP BY field, value""",
    "cooccurrence": """WITH f AS (SELECT user_id, event_type AS k FROM events WHERE value > 50 GROUP BY 1, 2 HAVING count(*) > 5), k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS k),
p AS (SELECT a.k AS a, b.k AS b FROM k a JOIN k b ON a.k <= b.k) SELECT p.a, p.b, count(y.user_id) AS n FROM p LEFT JOIN f x ON x.k = p.a LEFT JOIN f y ON y.k = p.b AND y.user_id = x.user_id GROUP BY 1, 2""",
    "event_log_union": "SELECT date, type, detail, count(*) AS n FROM (SELECT o_orderdate::DATE AS date, 'order' AS type, o_orderpriority AS detail FROM orders UNION ALL SELECT l_shipdate::DATE, 'shipment', l_returnflag FROM lineitem) GROUP BY 1, 2, 3",
    "dictionary_search": "SELECT p_partkey, p_name AS name FROM part WHERE (contains(lower(p_name), 'brass') OR contains(lower(p_type), 'brass') OR contains(lower(p_brand), 'brass')) AND (p_brand IN ('Brand#13', 'Brand#32') OR p_size IN (7, 12))",
    "dictionary_tags": "SELECT DISTINCT tag FROM (SELECT p_brand AS tag FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)",
    "patient_card": f"WITH {PATIENTS} SELECT pid AS patient_id, CASE WHEN event = 1 THEN 'Date of death' ELSE 'Last known alive' END AS label, CAST(last AS VARCHAR) AS date FROM surv",
    "patient_events": "SELECT o_custkey AS patient_id, count(*) AS n_administrations, count(*) FILTER (o_orderstatus = 'P') AS n_progressions FROM orders GROUP BY 1",
    "dq_gate": f"""WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, {LINES}, c(name, n) AS (
SELECT 'order_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'customer_name', count(*) FROM customer WHERE c_name IS NULL UNION ALL SELECT 'order_key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'item_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line_order', count(*) FROM (SELECT st, lag(st) OVER (PARTITION BY pid ORDER BY line) AS b FROM fin) WHERE st < b UNION ALL SELECT 'survival', count(*) FROM surv WHERE os_days < 0)
SELECT name AS "check", n AS n_fail, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
    "flatten_json": "SELECT event_id, 0 AS pos, 'Event' AS resource_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "partial_date_parse": f"""WITH {ODD}, p AS (SELECT o_orderkey, t, CASE WHEN t IS NULL OR t IN ('', 'unknown') THEN NULL WHEN len(t) = 7 THEN try_cast(t || '-15' AS DATE) WHEN len(t) = 4 THEN try_cast(t || '-07-01' AS DATE) ELSE try_cast(t[:10] AS DATE) END AS d FROM odd)
SELECT o_orderkey, d AS date, CASE WHEN d IS NULL THEN 'unknown' WHEN len(t) = 7 THEN 'month' WHEN len(t) = 4 THEN 'year' ELSE 'day' END AS precision, d IS NOT NULL AND len(t) IN (4, 7) AS assumed FROM p""",
    "resolve_date_length": f"WITH {ODD} SELECT o_orderkey, CASE WHEN len(t) >= 10 THEN try_cast(t[:10] AS DATE) WHEN len(t) = 4 THEN try_cast(t || '-07-01' AS DATE) WHEN len(t) = 7 AND t <> 'unknown' THEN try_cast(t || '-15' AS DATE) END AS date FROM odd",
    "partial_date_text": """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders)
SELECT o_orderkey, CASE WHEN k = 6 THEN NULL ELSE y END AS year, CASE WHEN k IN (0, 1, 3) THEN m WHEN k = 4 THEN 6 WHEN k = 5 THEN 9 END AS month, CASE WHEN k = 0 THEN d END AS day,
  CASE WHEN k = 0 THEN 'day' WHEN k = 2 THEN 'year' WHEN k = 6 THEN NULL ELSE 'month' END AS precision, CASE WHEN k = 6 THEN 'month out of range' END AS error FROM o""",
    "epoch_ms_roundtrip": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS again FROM events",
    "unit_convert": f"WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_partkey % 10 AS k FROM lineitem) SELECT l_orderkey, l_linenumber, round({_case(_FORMULAS)}, 6) AS converted, {_case([repr(e) if e else None for e in _ERRORS])} AS error, {_case([repr(c) if c else None for c in _CANONICAL])} AS canonical FROM u",
    "coded_vocab": "SELECT c_custkey, upper(c_mktsegment) IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS allowed, CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery' WHEN 'AUTOMOBILE' THEN 'AUTOMOBILE' ELSE c_mktsegment END AS code FROM customer",
    "coerce_matrix": """WITH p AS (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 5) THEN 'quantity_with_unit' WHEN k IN (1, 2) THEN 'integer' WHEN k = 3 THEN 'coded_value' ELSE 'partial_date' END AS target, CASE k WHEN 1 THEN 'unsafe coercion' WHEN 5 THEN 'unknown unit' END AS error, k NOT IN (1, 5) AS sound,
  CASE WHEN k = 3 THEN 'building' END AS code, CASE WHEN k = 4 THEN CAST('19' || CAST(p_size % 90 + 10 AS VARCHAR) AS INTEGER) END AS year FROM p""",
    "note_regex": f"""WITH {NOTE_TEXT}, {ABSTRACT} SELECT * EXCLUDE (patient_id, new_metastatic_sites, treatments_mentioned), array_to_string(new_metastatic_sites, ',') AS new_metastatic_sites, array_to_string(treatments_mentioned, ',') AS treatments_mentioned,
  CASE WHEN CAST(stage IS NOT NULL AS INT) + CAST(histology IS NOT NULL AS INT) + CAST(ecog IS NOT NULL AS INT) + CAST(pdl1_status IS NOT NULL AS INT) >= 3 THEN 'high' WHEN stage IS NOT NULL OR histology IS NOT NULL OR ecog IS NOT NULL OR pdl1_status IS NOT NULL THEN 'medium' ELSE 'low' END AS extraction_confidence,
  concat_ws(',', CASE WHEN stage IS NULL THEN 'stage' END, CASE WHEN histology IS NULL THEN 'histology' END) AS uncertain_fields FROM abs_""",
    "note_merge": f"WITH {NOTE_TEXT}, {ABSTRACT}, {MERGED} SELECT mrg.* EXCLUDE (new_metastatic_sites), array_to_string(new_metastatic_sites, ',') AS new_metastatic_sites, coalesce(treatments_mentioned, '') AS treatments_mentioned FROM mrg LEFT JOIN trt ON mrg.patient_id = trt.patient_id",
    "eval_scalar": f"WITH {NOTE_TEXT}, {ABSTRACT}, {MERGED}, {TRUTH}, {PAIRS}, {SCORES} SELECT field, n, round(accuracy, 9) AS accuracy, round(miss_rate, 9) AS miss_rate FROM scs",
    "eval_set_prf": f"WITH {NOTE_TEXT}, {ABSTRACT}, {MERGED}, {TRUTH}, {SETS} SELECT field, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f1s",
    "eval_confusion": f"WITH {NOTE_TEXT}, {ABSTRACT}, {MERGED}, {TRUTH}, {PAIRS} SELECT field, coalesce(t, 'None') AS truth, coalesce(p, 'None') AS found, count(*) AS n FROM prs WHERE field IN ('histology', 'stage', 'egfr_status') GROUP BY 1, 2, 3",
    "eval_labels": "SELECT 'quality' AS field, CAST(quality = 1 AS VARCHAR) AS truth, CAST(len(regexp_replace(text, '[^*#$%&!|]', '', 'g')) * 20 < len(text) AS VARCHAR) AS found, count(*) AS n FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE quality IS NOT NULL GROUP BY 2, 3",
    "macro_accuracy": f"""WITH {NOTE_TEXT}, {ABSTRACT}, {MERGED}, {TRUTH}, {PAIRS}, {SCORES}, {SETS},
num AS (SELECT avg(CASE WHEN abs(t.pdl1_tps - p.pdl1_tps) <= 0.5 OR (t.pdl1_tps IS NULL AND p.pdl1_tps IS NULL) THEN 1.0 ELSE 0.0 END) AS x FROM fst t JOIN mrg p ON t.patient_id = p.patient_id)
SELECT round(avg(x), 9) AS macro_accuracy FROM (SELECT accuracy AS x FROM scs UNION ALL SELECT x FROM num UNION ALL SELECT f1 FROM f1s)""",
}

def _pick(by: str, *values: str | None) -> str:
    """The value at by modulo the number of values."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


SQL["cohort_gate"] = f"""WITH RECURSIVE {PATIENTS}, {ADMINS}, {episodes()}, {LINES},
o AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderdate::DATE AS d FROM orders),
t AS (SELECT CASE WHEN pid % 97 <> 0 THEN pid END AS p, CASE WHEN pid % 89 <> 0 THEN idx END AS adv, idx + CASE WHEN pid % 41 = 0 THEN 5 ELSE -30 END AS ini, event = 1 AS dead,
  CASE WHEN event = 1 AND pid % 31 <> 0 THEN last - CASE WHEN pid % 37 = 0 THEN 9000 ELSE 0 END END AS dod, {_pick("pid", "IIIB", "IIIC", "IVA", "IVB", "II")} AS stage FROM surv),
c AS (SELECT 'non_null_ids' AS name, count(*) AS n FROM t WHERE p IS NULL OR adv IS NULL UNION ALL SELECT 'initial_before_advanced', count(*) FROM t WHERE adv < ini
UNION ALL SELECT 'progressions_after_advanced', count(*) FROM o JOIN t ON o.p = t.p WHERE d - 40 < adv UNION ALL SELECT 'biomarker_vocab', count(*) FROM o WHERE k % 4 = 2
UNION ALL SELECT 'stage_vocab', count(*) FROM t WHERE stage = 'II' UNION ALL SELECT 'death_date', count(*) FROM t WHERE dead AND dod IS NULL UNION ALL SELECT 'death_after_diagnosis', count(*) FROM t WHERE dod < adv
UNION ALL SELECT 'treatment_after_diagnosis', count(*) FROM o JOIN t ON o.p = t.p WHERE d - 20 < adv UNION ALL SELECT 'biomarker_patient', count(*) FROM o WHERE p NOT IN (SELECT p FROM t WHERE p IS NOT NULL)
UNION ALL SELECT 'survival_not_negative', count(*) FROM surv WHERE os_days < 0 UNION ALL SELECT 'lot_ordering', count(*) FROM (SELECT st, lag(st) OVER (PARTITION BY pid ORDER BY line) AS b FROM fin) WHERE st < b
UNION ALL SELECT 'lot_numbers', count(*) FROM (SELECT count(*) AS n, max(line) AS m FROM fin GROUP BY pid) WHERE n <> m)
SELECT name AS "check", n AS n_fail, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""

SQL["cohort_selection"] = f"""WITH o AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderkey // 4 AS r, o_orderdate::DATE AS d FROM orders),
cond AS (SELECT p, d, {_pick("r", "C34.1", "C34.90", "C50.9", "162.5", "C39.9", "C39.1", "C340")} AS code, {_pick("r", "8140/3", "8070/3", None, "8500/3", "8046/3", "8012/3", "8140/3", "8033/3", "8255/3", "8560/3", "8041/3")} AS m, {_pick("p", "IVA", "IIIB", "II", "IB", None)} AS stage FROM o WHERE k % 4 = 1),
ini AS (SELECT p, min(d) AS d, min(stage) AS stage FROM cond WHERE code IN ('C34.1', 'C34.90', '162.5', 'C39.9') GROUP BY p),
conf AS (SELECT p, arg_min(m, (d, m)) AS m FROM cond WHERE m NOT IN ('8500/3', '8041/3') GROUP BY p),
prog AS (SELECT p, d, {_pick("r", "to_advanced", "on_treatment_progression", "metastatic_recurrence")} AS kind, {_pick("r", "IVA", "IVB")} AS stage FROM o WHERE k % 4 = 2),
lat AS (SELECT p, min(d) AS d, arg_min(stage, (d, stage)) AS stage FROM prog WHERE kind <> 'on_treatment_progression' GROUP BY p),
adv AS (SELECT ini.p, conf.m, CASE WHEN ini.stage IN ('IVA', 'IIIB') THEN ini.d ELSE lat.d END AS d, CASE WHEN ini.stage IN ('IVA', 'IIIB') THEN ini.stage ELSE lat.stage END AS stage FROM ini JOIN conf ON ini.p = conf.p LEFT JOIN lat ON ini.p = lat.p
  WHERE ini.p NOT IN (SELECT p FROM cond WHERE m = '8041/3') AND (ini.d >= DATE '1993-01-01' OR lat.d IS NOT NULL)),
pat AS (SELECT c_custkey AS p, make_date(1950 + c_custkey % 40, 1 + c_custkey % 12, 1 + c_custkey % 28) AS dob FROM customer WHERE c_custkey % 50 <> 0 AND c_custkey % 6 NOT IN (2, 4)),
aged AS (SELECT adv.*, date_sub('year', dob, adv.d) AS age FROM adv JOIN pat ON adv.p = pat.p WHERE adv.d IS NOT NULL),
vis AS (SELECT aged.p FROM aged JOIN o ON o.p = aged.p WHERE k % 4 <> 3 AND o.d + 15 >= DATE '1993-01-01' GROUP BY aged.p HAVING count(*) >= 2 AND bool_or(o.d + 15 - aged.d BETWEEN 0 AND 90)),
ecog AS (SELECT aged.p, arg_min(r % 5, (abs(o.d + 10 - aged.d), o.d, r % 5)) AS e FROM aged JOIN o ON o.p = aged.p WHERE abs(o.d + 10 - aged.d) <= 30 GROUP BY aged.p)
SELECT aged.p AS patient_id, CAST(aged.d AS VARCHAR) AS advanced_diagnosis_date, m AS histology, stage AS stage_at_advanced_diagnosis, CAST(age AS INTEGER) AS age_at_advanced_diagnosis, e AS ecog_at_advanced_diagnosis
FROM aged JOIN vis ON aged.p = vis.p LEFT JOIN ecog ON aged.p = ecog.p WHERE age >= 18"""

_GENE_STATES = ", ".join(f"nullif({_pick(f'(c_custkey + {i})', 'positive', 'negative', 'not_tested')}, 'not_tested') AS {g}_status" for i, g in enumerate((*notes.GENES, "pdl1")))
SQL["note_truth"] = f"""WITH o AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderkey // 4 AS r, o_orderdate::DATE AS d FROM orders),
given AS (SELECT p, string_agg(x, ',' ORDER BY k) AS t FROM (SELECT p, {_pick("r", *notes.TREATMENTS)} AS x, min(k) AS k FROM o GROUP BY 1, 2) GROUP BY p),
prg AS (SELECT p, arg_max(d, (d, -k)) AS d, arg_max(r % 4, (d, -k)) AS n FROM o WHERE k % 4 <> 3 AND r % 2 = 1 GROUP BY p),
mrk AS (SELECT p, k, {_pick("r", "egfr", "kras", "alk")} AS g, {_pick("(r // 3)", "Exon 19 deletion", "L858R", "p.G12C", "g12d and G12V", "wild type", None)} AS v FROM o WHERE k % 3 <> 2),
var AS (SELECT p, arg_max(CASE WHEN v LIKE 'Exon%' THEN 'exon19_deletion' ELSE v END, k) FILTER (g = 'egfr' AND v IN ('Exon 19 deletion', 'L858R')) AS e, arg_max(CASE WHEN v LIKE 'p.%' THEN 'G12C' ELSE 'G12D' END, k) FILTER (g = 'kras' AND v LIKE '%12%') AS kr FROM mrk GROUP BY p)
SELECT c_custkey AS patient_id, {_pick("c_custkey", *notes.HISTOLOGIES)} AS histology, {_pick("c_custkey", "IVA", "IIIB")} AS stage, {_GENE_STATES}, e AS egfr_mutation, kr AS kras_variant, CAST(c_custkey % 100 AS DOUBLE) AS pdl1_tps, CAST(c_custkey % 5 AS INTEGER) AS ecog,
  prg.p IS NOT NULL AS progression_mentioned, CAST(prg.d AS VARCHAR) AS progression_date, array_to_string({notes.SITES}[1:coalesce(n, 0)], ',') AS new_metastatic_sites, coalesce(t, '') AS treatments_mentioned
FROM customer LEFT JOIN given ON given.p = c_custkey LEFT JOIN prg ON prg.p = c_custkey LEFT JOIN var ON var.p = c_custkey"""

SQL["derived_folder"] = SQL["derived_pipeline"]

SQL["all_conflicts"] = """WITH v AS (SELECT DISTINCT user_id AS pkey, event_type AS source, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT a.pkey, a.source AS source_a, a.k AS value_a, b.source AS source_b, b.k AS value_b FROM v a JOIN v b ON a.pkey = b.pkey AND a.source < b.source AND a.k <> b.k"""

#: Patients' orders as conditions, observations and medications, by thirds of customers.
CHART = f"""
ord AS (SELECT o_custkey AS c, o_custkey % 3 AS third, 'C' || o_custkey AS p, o_orderkey AS k, o_orderkey % 4 AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate::DATE AS VARCHAR) AS d,
  {_pick("(o_orderkey // 4)", "C34.1", "C34.90", "J18.9")} AS code, {_pick("(o_orderkey // 4)", "adenocarcinoma", "squamous | cell ^ type")} AS hist,
  {_pick("(o_orderkey // 4)", "718-7", "2160-0", "99999-1")} AS loinc, {_pick("(o_orderkey // 4)", "Hemoglobin", "Creatinine", 'Odd, "new" test')} AS lab, {_pick("(o_orderkey // 4)", "Keytruda", "Unknownib")} AS drug FROM orders),
fst AS (SELECT p, third, arg_min(code, id) FILTER (kind = 1) AS code, arg_min(hist, id) FILTER (kind = 1) AS hist, arg_min(d, id) FILTER (kind = 1) AS d, arg_min(loinc, id) FILTER (kind = 2) AS loinc, arg_min(lab, id) FILTER (kind = 2) AS lab,
  arg_min(drug, id) FILTER (kind = 3) AS drug, arg_min(loinc, k) FILTER (kind = 2) AS cl, arg_min(lab, k) FILTER (kind = 2) AS cb, arg_min(CASE WHEN kind = 2 THEN lab ELSE drug END, k) FILTER (kind IN (2, 3)) AS cd, arg_min(d, k) FILTER (kind IN (2, 3)) AS cdate FROM ord GROUP BY p, third),
rec AS (SELECT p, third, CASE WHEN third = 2 THEN coalesce(cdate, '') ELSE coalesce(d, '') END AS d, CASE WHEN third = 2 THEN cl ELSE loinc END AS loinc, CASE WHEN third = 2 THEN cb ELSE lab END AS lab, CASE WHEN third = 2 THEN cd ELSE drug END AS drug,
  CASE WHEN third < 2 THEN code WHEN drug IS NOT NULL THEN 'C34.2' END AS code, CASE WHEN third < 2 THEN hist WHEN cl IS NOT NULL THEN 'large' || chr(10) || 'cell' END AS hist FROM fst),
tll AS (SELECT p AS pkey, ['epic_fhir_r4', 'legacy_hl7v2', 'registry_csv_export'][third + 1] AS source, d, u.* FROM rec, LATERAL (SELECT * FROM (VALUES ('lab_test_code', loinc, 'coded_value', 'Coded lab result (' || lab || ')'), ('medication', drug, 'coded_value', 'Administered systemic therapy'),
  ('diagnosis_code', code, 'coded_value', 'Primary cancer diagnosis (ICD-10-CM)'), ('tumor_histology_text', hist, 'text', 'Free-text histology from the pathology narrative')) x(source_column, value, source_data_type, source_description) WHERE value IS NOT NULL) u)"""

SQL["source_records"] = f"WITH {CHART} SELECT pkey, source, source || ':' || pkey AS external_id, d AS occurred_at, source_column, value, source_data_type, source_description FROM tll"
_KNOWN_ICD = ", ".join(f"'{c}'" for c, _ in registries.ICD10)
SQL["split_sources"] = f"SELECT * FROM ({SQL['source_records']}) WHERE source <> 'epic_fhir_r4'"
SQL["store_signals"] = f"""WITH {SIGNALS}, one AS (SELECT pkey, source, max(id) AS id, arg_max(k, id) AS k, arg_max(occurred_at, id) AS t FROM sig GROUP BY pkey, source)
SELECT CAST(pkey AS VARCHAR) AS pkey, source, id, CAST(k AS VARCHAR) AS k, first_value(id) OVER (PARTITION BY pkey ORDER BY t DESC, CAST(id AS VARCHAR) DESC) AS last_id FROM one"""
SQL["store_decisions"] = f"WITH {DECISIONS} SELECT CAST(pkey AS VARCHAR) AS pkey, source_column, arg_max(id, (decided_at, CAST(id AS VARCHAR))) AS id, arg_max(verdict, (decided_at, CAST(id AS VARCHAR))) AS verdict, count(*) AS n FROM dec GROUP BY pkey, source_column"
SQL["stream_latest"] = f"WITH {SIGNALS} SELECT CAST(pkey AS VARCHAR) AS pkey, arg_max(id, (occurred_at, CAST(id AS VARCHAR))) AS id, arg_max(CAST(k AS VARCHAR), (occurred_at, CAST(id AS VARCHAR))) AS k FROM sig GROUP BY pkey"
SQL["stream_routing"] = f"""WITH {DECISIONS}, per AS (SELECT CAST(pkey AS VARCHAR) AS pkey, source_column, any_value(pkey % 3) AS part, any_value(verdict) AS verdict, any_value(canonical_name) AS canonical_name, count(*) AS n, max(id) AS last_value, min(decided_at) < '2024-01-16' AS early FROM dec GROUP BY dec.pkey, source_column)
SELECT pkey, source_column, 'routed' AS kind, verdict, canonical_name, n, last_value FROM per WHERE part > 0
UNION ALL SELECT pkey, source_column, 'request', NULL, NULL, 1, NULL FROM per WHERE part = 0 OR part = 2 AND early"""
SQL["offline_many_values"] = """WITH v AS (SELECT CAST(c_nationkey AS VARCHAR) AS pkey, c_nationkey % 3 = 0 AND o_orderkey % 5 = 0 AS odd, CASE WHEN odd THEN 'told: ' || o_orderkey ELSE repeat(' ', o_orderkey % 30) || (['C34.00', 'C34.10', 'C34.2', 'C34.90', 'J44'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT pkey, least(count(DISTINCT value), 20) AS n_samples, min(value) AS first_sample, CASE WHEN NOT bool_or(odd) THEN count(*) END AS n_kept FROM v GROUP BY pkey"""
SQL["routing_decisions"] = f"""WITH {CHART}, hit AS (SELECT *, CASE WHEN source_column = 'lab_test_code' AND value = '718-7' THEN 'hemoglobin' WHEN source_column = 'lab_test_code' AND value = '2160-0' THEN 'creatinine'
  WHEN source_column = 'medication' AND value = 'Keytruda' THEN 'drug_name' WHEN source_column = 'diagnosis_code' AND value IN ({_KNOWN_ICD}) THEN 'diagnosis_code' END AS h FROM tll)
SELECT pkey, source, source_column, CASE WHEN h IS NULL THEN 'rule' ELSE 'lookup' END AS decided_by, CASE WHEN h IS NULL THEN 'append' ELSE 'join' END AS verdict, coalesce(h, source_column) AS canonical_name,
  CASE WHEN h IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity_score, coalesce(h = 'hemoglobin', false) AS is_global_target, false AS needs_review, CAST(1 AS INTEGER) AS n_samples FROM hit"""
_HITS = SQL["routing_decisions"].partition("SELECT pkey, source, source_column, CASE")[0]
SQL["gated_decisions"] = f"""WITH {DECISIONS}, raw AS (SELECT id AS n, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 40 = 1 THEN id - 1 ELSE id END AS id, CASE WHEN id % 70 = 0 THEN 'perhaps' ELSE verdict END AS verdict, id % 90 = 0 AS odd FROM dec),
one AS (SELECT *, list_filter([CASE WHEN id IS NULL THEN 'id is missing' END, CASE WHEN verdict = 'perhaps' THEN 'unknown verdict' END, CASE WHEN odd THEN 'score outside 0 to 1' END], lambda x: x IS NOT NULL) AS r FROM raw),
two AS (SELECT *, CASE WHEN len(r) = 0 AND n % 2 = 0 THEN n END AS early FROM one),
three AS (SELECT t.*, CASE WHEN t.id IS NOT NULL AND t.n % 2 = 1 AND e.early IS NOT NULL THEN list_append(t.r, 'id is taken') ELSE t.r END AS why FROM two t LEFT JOIN (SELECT early, id AS eid FROM two WHERE early IS NOT NULL) e ON t.id = e.eid AND t.n % 2 = 1)
SELECT CASE WHEN len(why) = 0 THEN 'written' ELSE array_to_string(why, '; ') END AS what, 'default' AS workspace_key, false AS is_global_target, count(*) AS n, min(CASE WHEN len(why) = 0 THEN id ELSE n END) AS least FROM three GROUP BY 1"""
SQL["journey_checks"] = """SELECT unnest(['no drug of its own', 'begins before the end', 'no progression between', 'after the last day', 'shares of lines']) AS "check", 0 AS n_fail UNION ALL SELECT 'patients', count(*) FROM customer"""
_DAY = """'{"value":"' || {} || '","precision":"day"}'""".replace("{", "{{").replace("}", "}}").replace("{{}}", "{}")
SQL["core_load"] = f"""WITH c AS (SELECT * FROM customer WHERE c_custkey % 13 > 0 AND c_custkey % 11 > 0)
SELECT 'patient' AS what, c_mktsegment AS id, {_DAY.format("'2020-01-02'")} AS detail, NULL AS dose, count(*) AS n FROM c GROUP BY c_mktsegment
UNION ALL SELECT 'medication', CAST(o_orderkey AS VARCHAR), 'C' || o_custkey || ' ' || CASE WHEN o_orderkey % 3 > 0 THEN '{{"code":"40048","system":"rxnorm","display":"' || lower(trim(o_orderpriority)) || '"}} ' ELSE '' END || {_DAY.format("CAST(o_orderdate::DATE AS VARCHAR)")},
  '{{"value":' || (o_orderkey % 7) || '.0,"unit":"mg"}}', 1 FROM orders JOIN c ON o_custkey = c_custkey
UNION ALL SELECT 'rejected', CASE WHEN c_custkey % 13 = 0 THEN 'no profile' ELSE 'no patient_id' END, NULL, NULL, count(*) FROM customer WHERE c_custkey % 13 = 0 OR c_custkey % 11 = 0 GROUP BY 2"""
SQL["saved_definition"] = f"""WITH {PATIENTS} SELECT pid AS patient_id, CAST(20 + pid % 60 AS INTEGER) AS age, CASE WHEN event = 1 THEN 'deceased' ELSE 'alive' END AS vital_status FROM surv
WHERE 20 + pid % 60 >= 30 AND (event = 1 OR nation IN (3, 4, 5)) AND coalesce(seg, '') <> 'BUILDING' AND (event = 0 OR 20 + pid % 60 <= 60)"""
SQL["bundle_by_patient"] = """WITH s AS (SELECT 'C' || c_custkey AS p, CASE WHEN c_custkey % 3 > 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'malformed' WHEN c_custkey % 7 = 0 THEN 'empty' WHEN c_custkey % 11 = 0 THEN 'no bundle' ELSE 'found' END AS status FROM customer)
SELECT status, count(*) AS n, CASE WHEN status = 'found' THEN count(*) ELSE 0 END AS n_bundles, min(p) AS first FROM s GROUP BY status"""
SQL["decision_snapshot"] = f"""WITH {DECISIONS} SELECT d.source_column, d.decided_by, d.verdict, d.canonical_name, count(*) AS n, max('says "so", ' || d.id) AS reason, max(strftime(d.decided_at, '%Y-%m-%d %H:%M:%S')) AS last, round(sum(e.value), 2) AS score FROM dec d JOIN events e ON d.id = e.event_id GROUP BY ALL"""
SQL["asked_notes"] = r"""SELECT doc_id, CASE WHEN e IS NULL THEN CAST(n AS VARCHAR) END AS answer, e AS error, CASE WHEN text IS NULL THEN NULL WHEN n % 10 = 7 THEN 3 WHEN e IS NULL AND n % 3 = 0 THEN 2 WHEN text IS NOT NULL THEN 1 END AS attempts FROM
(SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) % 10 = 7 THEN 'ConnectionError' WHEN regexp_matches(text, '^\s') THEN 'ValueError' END AS e FROM documents)"""
SQL["ingest_report"] = f"""{_HITS}, kept AS (SELECT DISTINCT source, pkey FROM hit WHERE h IS NOT NULL), two AS (SELECT count(*) + 2 AS n, count(*) FILTER (source_column <> 'diagnosis_code') AS wrong FROM hit WHERE h IS NOT NULL)
SELECT 'file' AS part, NULL AS name, f AS what, NULL AS detail, (SELECT count(*) FROM kept WHERE source = s) AS n FROM (VALUES ('fhir', 'epic_fhir_r4'), ('hl7v2', 'legacy_hl7v2'), ('csv', 'registry_csv_export')) t(f, s)
UNION ALL SELECT 'file', name, f, error, n FROM (VALUES ('a.json', 'fhir', 'not a bundle', 0), ('b.json', 'fhir', 'no patient', 0), ('c', 'hl7v2', 'no patient', 0), ('d', NULL, 'unknown format', 0), ('e.csv', 'csv', NULL, 2)) t(name, f, error, n)
UNION ALL SELECT 'line', 'e.csv', error, NULL, n FROM (VALUES ('no patient', 2), ('ECOG is no number', 1)) t(error, n)
UNION ALL SELECT 'held', source, source_column, any_value(source_data_type), count(*) FROM hit WHERE h IS NULL GROUP BY source, source_column
UNION ALL SELECT 'held', unnest(['registry_csv_export', 'epic_fhir_r4']), 'ecog_performance_status', 'integer', 1
UNION ALL SELECT 'value', source, source_column, 'no code system', count(*) FROM hit WHERE h IS NOT NULL AND source_column <> 'diagnosis_code' GROUP BY source, source_column
UNION ALL SELECT 'tally', NULL, unnest(['lookup', 'normalizer', 'verdict:join']), NULL, unnest([n, wrong, n + wrong]) FROM two
UNION ALL SELECT 'total', NULL, 'records', NULL, count(DISTINCT pkey) + 3 FROM tll UNION ALL SELECT 'total', NULL, 'file_errors', NULL, 4 UNION ALL SELECT 'total', NULL, 'line_errors', NULL, 3"""
SQL["source_formats"] = f"""WITH {CHART}, n AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer JOIN ord ON c = c_custkey WHERE third = 2 AND kind IN (2, 3)), t AS (SELECT count(*) FILTER (c_custkey % 3 = 0) AS a, count(*) FILTER (c_custkey % 3 = 1) AS b FROM customer)
SELECT 'fhir' AS what, a + 2 AS n FROM t UNION ALL SELECT 'hl7v2', b + 1 FROM t UNION ALL SELECT 'csv', n FROM n UNION ALL SELECT 'none', 1 UNION ALL SELECT 'not a bundle', 1 UNION ALL SELECT 'no patient', 2 UNION ALL SELECT 'unknown format', 1"""
SQL["staged_resources"] = f"""WITH {CHART} SELECT 'Patient' AS kind, 'C' || c_custkey || '.json' AS name, 'C' || c_custkey AS id, '19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-03-04' AS date, {_pick("c_custkey", "male", "female")} AS detail FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT ['Condition', 'Observation', 'MedicationAdministration'][kind], p || '.json', id, d, CASE kind WHEN 1 THEN code WHEN 2 THEN loinc ELSE drug END FROM ord WHERE third = 0 AND kind > 0"""
SQL["staged_messages"] = f"""WITH {CHART}, seen AS (SELECT p, count(*) AS n, min(d) AS first, max(loinc) AS code, max(lab) AS display FROM ord WHERE kind = 2 GROUP BY p)
SELECT 'C' || c_custkey || '.txt' AS name, 'C' || c_custkey AS patient_id, '19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '0304' AS birth, {_pick("c_custkey", "M", "F")} AS sex, coalesce(n, 0) AS n_observations, first, code, display FROM customer LEFT JOIN seen ON p = 'C' || c_custkey WHERE c_custkey % 3 = 1"""
SQL["staged_extracts"] = """SELECT l_orderkey || '-' || l_linenumber AS observation_id, 'C' || l_orderkey AS patient_id, '718-7' AS code, CASE WHEN l_orderkey % 3 > 0 THEN 'Hemoglobin' END AS display,
CASE WHEN l_orderkey % 5 > 1 THEN CAST(l_quantity AS DOUBLE) END AS value, 'g/dL' AS unit FROM lineitem"""
SQL["note_types"] = f"SELECT doc_id, {_pick('doc_id', 'progress', 'consult', 'pathology', 'radiology', 'unknown', 'pathology')} AS note_type FROM documents"
SQL["medication_timeline"] = """SELECT o_custkey AS patient_id, o_orderpriority AS drug, CAST(o_orderdate::DATE AS VARCHAR) AS start, CAST(o_orderdate::DATE + CASE WHEN o_orderkey % 3 = 1 THEN 7 ELSE 0 END AS VARCHAR) AS "end"
FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 > 0 UNION ALL SELECT o_custkey, o_orderpriority, CAST(o_orderdate::DATE AS VARCHAR), CAST(o_orderdate::DATE AS VARCHAR) FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 3 = 0"""
SQL["patient_tables"] = f"WITH {PATIENTS}, {ADMINS} SELECT 'administrations' AS events, count(*) AS n FROM adm WHERE pid = 7 UNION ALL SELECT 'progressions', count(*) FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'P' UNION ALL SELECT 'deaths', count(*) FROM surv WHERE pid = 7 AND event = 1"

#: Columns that are dates in the SQL above; they leave it as ISO text.
DATES = {
    "rwos_records": ["index_date", "event_date"], "episodes_gap_islands": ["start", "end"], "lot_greedy": ["start", "end"], "lot_lines": ["start_date", "end_date"], "lot_sql_mart": ["line_start_date", "line_end_date"],
    "new_drug_not_in": ["start"], "progressed_exists": ["start"], "nearest_within_30d": ["date", "dose_end"], "decisions_per_day": ["day"], "event_log_union": ["date"], "partial_date_parse": ["date"], "resolve_date_length": ["date"],
}
for _name, _columns in DATES.items():
    _casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in _columns)
    SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]})"
