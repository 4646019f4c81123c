"""Queries over an audit panel made of documents and labels: cases, decisions, scores, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cec, gate, panel, score, statistics
from ..session import table
from .registry import query

PANEL = """d AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled, l.quality, l.toxic, ['T-FILE', 'T-COL', 'T-VAL', 'T-ID', 'T-GOV'][(d.doc_id % 5 + 1)::INT] AS task FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT *, CASE task WHEN 'T-FILE' THEN CASE WHEN quality = 0 THEN 'mixed' ELSE 'demographics' END WHEN 'T-COL' THEN CASE WHEN quality = 0 THEN 'panss_item' ELSE 'diagnosis' END WHEN 'T-VAL' THEN 'value_encoding' WHEN 'T-ID' THEN 'identifier_linkage' ELSE 'release_policy' END AS true_label,
 CASE task WHEN 'T-FILE' THEN CASE WHEN quality = 0 THEN 'demographics' ELSE 'mixed' END WHEN 'T-COL' THEN CASE WHEN quality = 0 THEN 'diagnosis' ELSE 'panss_item' END ELSE 'unknown' END AS other_label, doc_id % 4 = 1 AND labelled AS gold_corruption FROM d),
g AS (SELECT *, substr(sha256('doc|' || doc_id::VARCHAR), 1, 24) AS case_id, lang AS study, source AS lineage_group, CASE WHEN gold_corruption THEN 'corrupted_' ELSE 'clean_' END || task AS error_family, CASE WHEN labelled THEN 'curated' ELSE 'procedural_missing_evidence' END AS oracle_status,
 CASE WHEN task IN ('T-FILE', 'T-COL') THEN CASE WHEN gold_corruption THEN other_label ELSE true_label END END AS proposal,
 CASE WHEN NOT labelled THEN 'abstain' WHEN toxic = 1 THEN 'escalate' WHEN gold_corruption THEN 'recover' ELSE 'accept_provisionally' END AS gold_action,
 CASE WHEN labelled OR task NOT IN ('T-FILE', 'T-COL') THEN true_label END AS gold_label,
 CASE doc_id % 3 WHEN 0 THEN [['profile_values']] WHEN 1 THEN [['get_dictionary_entry'], ['compare_redundant_values']] ELSE [[]::VARCHAR[]] END AS required FROM t),
p AS (SELECT *, CASE WHEN gold_action = 'recover' THEN '{"label":"' || true_label || '"}' END AS gold_repair FROM g)"""


def panel_cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a document, with its oracle."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(labels, docs["doc_id"] == labels["l_id"], "left")
    task = F.element_at(F.array(*map(F.lit, ("T-FILE", "T-COL", "T-VAL", "T-ID", "T-GOV"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = rows.withColumns({"labelled": F.col("l_id").isNotNull(), "task": task})
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    swap = lambda a, b: F.when(bad, b).otherwise(a)
    t = F.col("task")
    semantic = t.isin("T-FILE", "T-COL")
    true = F.when(t == "T-FILE", swap("demographics", "mixed")).when(t == "T-COL", swap("diagnosis", "panss_item")).when(t == "T-VAL", "value_encoding").when(t == "T-ID", "identifier_linkage").otherwise("release_policy")
    other = F.when(t == "T-FILE", swap("mixed", "demographics")).when(t == "T-COL", swap("panss_item", "diagnosis")).otherwise("unknown")
    rows = rows.withColumns({"true_label": true, "other_label": other, "gold_corruption": (F.col("doc_id") % 4 == 1) & F.col("labelled")})
    sets = lambda *s: F.array(*[F.array(*map(F.lit, x)) for x in s])
    empty = F.array(F.array().cast("array<string>"))
    m = F.col("doc_id") % 3
    rows = rows.select(
        "*",
        S.case_id(F.lit("doc"), "doc_id").alias("case_id"),
        F.col("lang").alias("study"),
        F.col("source").alias("lineage_group"),
        F.concat(F.when(F.col("gold_corruption"), "corrupted_").otherwise("clean_"), t).alias("error_family"),
        F.when(F.col("labelled"), "curated").otherwise("procedural_missing_evidence").alias("oracle_status"),
        F.when(semantic, F.when(F.col("gold_corruption"), F.col("other_label")).otherwise(F.col("true_label"))).alias("proposal"),
        F.when(~F.col("labelled"), "abstain").when(F.col("toxic") == 1, "escalate").when(F.col("gold_corruption"), "recover").otherwise("accept_provisionally").alias("gold_action"),
        F.when(F.col("labelled") | ~semantic, F.col("true_label")).alias("gold_label"),
        F.when(m == 0, sets(["profile_values"])).when(m == 1, sets(["get_dictionary_entry"], ["compare_redundant_values"])).otherwise(empty).alias("required"),
    )
    return rows.withColumn("gold_repair", F.when(F.col("gold_action") == "recover", gate.canonical(("label", F.col("true_label")))))


def _arm(rows: DataFrame, visible: bool) -> DataFrame:
    n, k, t = F.col("n_chars"), int(visible), F.col("task")
    label = F.when((n + k) % 6 == 0, F.col("other_label")).when((n + k) % 13 != 0, F.col("true_label"))
    rows = rows.withColumn("label", label)
    differs = ~F.col("label").eqNullSafe(F.col("proposal")) & F.lit(visible)
    action = F.when(n % 31 == 0, F.lit(None).cast("string")).when(t == "T-GOV", "escalate").when(n % 9 == 0, "abstain").when(differs, "recover").otherwise("accept_provisionally")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    d4, d7 = F.col("doc_id") % 4, F.col("doc_id") % 7
    return rows.withColumns(
        {
            "action": action,
            "called": F.when(d4 == 0, words("profile_values")).when(d4 == 1, words("profile_values", "get_dictionary_entry")).when(d4 == 2, words()).otherwise(words("compare_redundant_values")),
            "observed": F.when(F.col("doc_id") % 10 == 0, words()),
            "history": F.when(d7 == 0, words("unavailable")).when(d7 == 1, words("rejected", "rejected")).when(d7 == 2, words("duplicate_tool")).when(d7 == 3, words("invalid_json")).otherwise(words()),
            "parse_success": n % 17 != 0,
            "matches_flag": F.when(n % 5 != 0, n % 5 != 1),
        }
    ).withColumn("repair", F.when(F.col("action") == "recover", F.when(F.col("label").isNotNull(), gate.canonical(("label", F.col("label"))))))


def metrics_of(spark: SparkSession, sf_dir: str, visible: bool = False) -> DataFrame:
    return score.scored(_arm(panel_cases_of(spark, sf_dir), visible))


def _metrics_sql(arm: str, visible: bool) -> str:
    k = int(visible)
    return f"""{arm}a AS (SELECT *, CASE WHEN (n_chars + {k}) % 6 = 0 THEN other_label WHEN (n_chars + {k}) % 13 <> 0 THEN true_label END AS label,
 CASE doc_id % 4 WHEN 0 THEN ['profile_values'] WHEN 1 THEN ['profile_values', 'get_dictionary_entry'] WHEN 2 THEN []::VARCHAR[] ELSE ['compare_redundant_values'] END AS called,
 CASE doc_id % 7 WHEN 0 THEN ['unavailable'] WHEN 1 THEN ['rejected', 'rejected'] WHEN 2 THEN ['duplicate_tool'] WHEN 3 THEN ['invalid_json'] ELSE []::VARCHAR[] END AS history, n_chars % 17 <> 0 AS parse_success, CASE WHEN n_chars % 5 <> 0 THEN n_chars % 5 <> 1 END AS matches_flag FROM p),
{arm}b AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN []::VARCHAR[] ELSE called END AS observed, CASE WHEN n_chars % 31 = 0 THEN NULL WHEN task = 'T-GOV' THEN 'escalate' WHEN n_chars % 9 = 0 THEN 'abstain' WHEN {str(visible).lower()} AND label IS DISTINCT FROM proposal THEN 'recover' ELSE 'accept_provisionally' END AS action FROM {arm}a),
{arm}c AS (SELECT *, CASE WHEN action = 'recover' THEN '{{"label":"' || label || '"}}' END AS repair, len(list_filter(called, lambda x: list_contains(flatten(required), x))) AS relevant FROM {arm}b),
{arm}e AS (SELECT *, action IS NOT DISTINCT FROM gold_action AS action_correct, label IS NOT DISTINCT FROM gold_label AS label_correct, repair IS NOT DISTINCT FROM gold_repair AS exact_repair, label IS NULL AS pred_label_missing,
 len(list_filter(required, lambda r: list_has_all(observed, r))) > 0 AS decisive_evidence_acquired, len(list_filter(required, lambda r: len(r) > 0)) > 0 AS evidence_required, coalesce(action IN ('recover', 'accept_provisionally'), false) AS committed,
 len(called) AS calls, len(observed) AS observed_evidence_n, len(called) - relevant AS nonminimal_calls, CASE WHEN len(called) > 0 THEN relevant / len(called)::DOUBLE END AS relevant_tool_precision, action IS DISTINCT FROM 'accept_provisionally' AS predicted_intervention FROM {arm}c),
{arm} AS (SELECT *, NOT evidence_required OR decisive_evidence_acquired AS evidence_supported, action_correct AND label_correct AND exact_repair AND (NOT evidence_required OR decisive_evidence_acquired) AS case_success, committed AND NOT (action_correct AND label_correct AND exact_repair AND (NOT evidence_required OR decisive_evidence_acquired)) AS unsafe_commit FROM {arm}e)"""


_H, _V = f"WITH {PANEL}, {_metrics_sql('h', False)} ", f"WITH {PANEL}, {_metrics_sql('v', True)} "
_HV = f"WITH {PANEL}, {_metrics_sql('h', False)}, {_metrics_sql('v', True)} "


def _r(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double"})


_CASE_COLUMNS = ["case_id", "study", "task", "error_family", "lineage_group", "oracle_status", "gold_corruption", "proposal", "gold_action", "gold_label", "gold_repair"]


@query(f"WITH {PANEL} SELECT {', '.join(_CASE_COLUMNS)}, len(required)::INT AS required_sets FROM p")
def panel_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_cases_of(spark, sf_dir).select(*_CASE_COLUMNS, F.size("required").alias("required_sets"))


@query(f"WITH {PANEL} SELECT 'task' AS dimension, task AS value, count(*) AS n FROM p GROUP BY task UNION ALL SELECT 'study', study, count(*) FROM p GROUP BY study UNION ALL SELECT 'error_family', error_family, count(*) FROM p GROUP BY error_family")
def panel_task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.counts(panel_cases_of(spark, sf_dir), ["task", "study", "error_family"])


_METRIC_COLUMNS = [
    "case_id", "gold_action", "gold_label", "pred_label_missing", "action_correct", "label_correct", "exact_repair", "evidence_supported", "case_success", "committed", "unsafe_commit",
    "decisive_evidence_acquired", "evidence_required", "calls", "observed_evidence_n", "nonminimal_calls", "parse_success", "predicted_intervention", "relevant_tool_precision",
]


@query(_V + f"SELECT {', '.join(_METRIC_COLUMNS)}, action AS pred_action, label AS pred_label, len(list_filter(history, lambda x: x = 'rejected')) AS gate_rejections, len(list_filter(history, lambda x: x = 'unavailable')) AS unavailable_tool_calls FROM v")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(spark, sf_dir, True).select(*_METRIC_COLUMNS, F.col("action").alias("pred_action"), F.col("label").alias("pred_label"), "gate_rejections", "unavailable_tool_calls")


_SUMMARY = """count(*) AS n, round(avg(case_success::INT), 6) AS case_success, round(avg(action_correct::INT), 6) AS action_accuracy, round(avg(label_correct::INT), 6) AS label_accuracy, round(avg(exact_repair::INT), 6) AS exact_repair_accuracy,
round(avg(unsafe_commit::INT), 6) AS unsafe_commit_rate, round(avg(committed::INT), 6) AS coverage, round(avg(unsafe_commit::INT) FILTER (committed), 6) AS selective_risk, round(avg(decisive_evidence_acquired::INT), 6) AS decisive_evidence_rate,
round(avg(decisive_evidence_acquired::INT) FILTER (evidence_required), 6) AS decisive_evidence_rate_required, round(avg(calls), 6) AS mean_calls, round(avg(nonminimal_calls), 6) AS mean_nonminimal_calls"""
_DIMENSIONS = ["task", "study", "error_family", "oracle_status"]


@query(_H + " UNION ALL ".join([f"SELECT '{k}' AS dimension, {k} AS value, {_SUMMARY} FROM h GROUP BY {k}" for k in _DIMENSIONS] + [f"SELECT 'all' AS dimension, NULL AS value, {_SUMMARY} FROM h"]))
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(score.grouped_summaries(metrics_of(spark, sf_dir), _DIMENSIONS))


def _f1_sql(gold: str, pred: str) -> str:
    return f"""SELECT count(*) AS labels, round(avg(2 * t / (g + p)::DOUBLE), 6) AS macro_f1 FROM (SELECT label, sum(g) AS g, sum(p) AS p, sum(t) AS t FROM (
SELECT coalesce({gold}, '__missing__') AS label, 1 AS g, 0 AS p, (coalesce({gold}, '__missing__') = coalesce({pred}, '__missing__'))::INT AS t FROM h UNION ALL SELECT coalesce({pred}, '__missing__'), 0, 1, 0 FROM h) GROUP BY label)"""


@query(_H + f"SELECT 'action' AS target, * FROM ({_f1_sql('gold_action', 'action')}) UNION ALL SELECT 'label' AS target, * FROM ({_f1_sql('gold_label', 'label')})")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics_of(spark, sf_dir)
    both = [score.macro_f1(m, g, p).select(F.lit(n).alias("target"), "*") for n, g, p in (("action", "gold_action", "action"), ("label", "gold_label", "label"))]
    return _r(both[0].unionByName(both[1]))


@query(_V + "SELECT tp, round(coalesce(tp / nullif(pp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(ap, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(pp + ap, 0)::DOUBLE, 0), 6) AS f1 FROM (SELECT count(*) FILTER (predicted_intervention AND gold_corruption) AS tp, count(*) FILTER (predicted_intervention) AS pp, count(*) FILTER (gold_corruption) AS ap FROM v WHERE task <> 'T-GOV')")
def intervention_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(score.intervention(metrics_of(spark, sf_dir, True)))


@query(_V + """SELECT round(avg(action_correct::INT) FILTER (gold_action = 'recover'), 6) AS recovery_accuracy, round(avg(relevant_tool_precision), 6) AS relevant_tool_precision, round(avg((action IS NOT DISTINCT FROM 'abstain')::INT), 6) AS abstention_rate, round(avg((action IS NOT DISTINCT FROM 'escalate')::INT), 6) AS escalation_rate, round(avg(parse_success::INT), 6) AS parse_rate,
round(avg(len(list_filter(history, lambda x: x = 'unavailable'))), 6) AS mean_unavailable_tool_calls, round(avg(len(list_filter(history, lambda x: x = 'duplicate_tool'))), 6) AS mean_duplicate_tool_events, round(avg(len(list_filter(history, lambda x: x = 'rejected'))), 6) AS mean_gate_rejections, round(avg(len(list_filter(history, lambda x: x = 'invalid_json'))), 6) AS mean_invalid_json_events, round(avg(len(list_filter(history, lambda x: x = 'budget_exhausted'))), 6) AS mean_budget_exhaustion_events FROM v""")
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(score.headline(metrics_of(spark, sf_dir, True)))


_ARM = """count(*) AS n, round(avg(label_correct::INT), 6) AS label_accuracy, round(avg(action_correct::INT), 6) AS action_accuracy, round(avg(case_success::INT), 6) AS case_success, round(avg(unsafe_commit::INT), 6) AS unsafe_rate, round(avg(committed::INT), 6) AS coverage,
count(*) FILTER (committed) AS committed_n, count(*) FILTER (committed AND unsafe_commit) AS unsafe_n, count(*) FILTER (gold_repair IS NOT NULL) AS repair_targets, count(*) FILTER (gold_repair IS NOT NULL AND exact_repair) AS repairs"""


@query(_HV + f"SELECT 'hidden' AS arm, {_ARM} FROM h UNION ALL SELECT 'visible' AS arm, {_ARM} FROM v")
def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics_of(spark, sf_dir).withColumn("arm", F.lit("hidden")).unionByName(metrics_of(spark, sf_dir, True).withColumn("arm", F.lit("visible")))
    return _r(score.arm_metrics(both, "arm"))


@query(_H + "SELECT count(*) AS n, count(matches_flag) AS present, count(*) FILTER (matches_flag) AS true_n, count(*) FILTER (NOT matches_flag) AS false_n, count(*) - count(matches_flag) AS missing FROM h")
def contract_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.contract_compliance(metrics_of(spark, sf_dir))


@query(_HV + """SELECT count(*) AS n, count(*) FILTER (h.action IS DISTINCT FROM 'recover' AND h.label IS DISTINCT FROM h.proposal) AS hidden, count(*) FILTER (v.action IS DISTINCT FROM 'recover' AND v.label IS DISTINCT FROM v.proposal) AS visible
FROM h JOIN v USING (case_id) WHERE h.task IN ('T-FILE', 'T-COL') AND h.gold_corruption AND h.label_correct AND v.label_correct""")
def ucr_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.ucr_intersection(metrics_of(spark, sf_dir), metrics_of(spark, sf_dir, True))


_NUMBERS = f"""SELECT 'arms' AS section, arm, metric, value FROM (UNPIVOT (SELECT arm, COLUMNS(* EXCLUDE arm)::DOUBLE FROM (SELECT 'hidden' AS arm, {_ARM} FROM h UNION ALL SELECT 'visible' AS arm, {_ARM} FROM v)) ON COLUMNS(* EXCLUDE arm) INTO NAME metric VALUE value)
UNION ALL SELECT 'contract', arm, metric, value FROM (UNPIVOT (SELECT arm, count(*)::DOUBLE AS n, count(matches_flag)::DOUBLE AS present, count(*) FILTER (matches_flag)::DOUBLE AS true_n FROM (SELECT 'hidden' AS arm, matches_flag FROM h UNION ALL SELECT 'visible', matches_flag FROM v) GROUP BY arm) ON n, present, true_n INTO NAME metric VALUE value)
UNION ALL SELECT 'contradictory_approvals', arm, metric, value FROM (UNPIVOT (SELECT arm, count(*) FILTER (s)::DOUBLE AS n, count(*) FILTER (s AND action = 'accept_provisionally' AND label <> proposal)::DOUBLE AS contradictory FROM (SELECT 'hidden' AS arm, action, label, proposal, task IN ('T-FILE', 'T-COL') AND gold_corruption AS s FROM h UNION ALL SELECT 'visible', action, label, proposal, task IN ('T-FILE', 'T-COL') AND gold_corruption FROM v) GROUP BY arm) ON n, contradictory INTO NAME metric VALUE value)
UNION ALL SELECT 'ucr_intersection', 'hidden_visible', metric, value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS n, count(*) FILTER (h.action IS DISTINCT FROM 'recover' AND h.label IS DISTINCT FROM h.proposal)::DOUBLE AS hidden, count(*) FILTER (v.action IS DISTINCT FROM 'recover' AND v.label IS DISTINCT FROM v.proposal)::DOUBLE AS visible FROM h JOIN v USING (case_id) WHERE h.task IN ('T-FILE', 'T-COL') AND h.gold_corruption AND h.label_correct AND v.label_correct) ON n, hidden, visible INTO NAME metric VALUE value)"""


@query(_HV + _NUMBERS)
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of both arms in one table."""
    both = metrics_of(spark, sf_dir).withColumn("arm", F.lit("hidden")).unionByName(metrics_of(spark, sf_dir, True).withColumn("arm", F.lit("visible")))
    return _r(score.report(both))


@query(_H + "SELECT count(*) AS n, count(*) FILTER (action = 'accept_provisionally' AND label <> proposal) AS contradictory FROM h WHERE task IN ('T-FILE', 'T-COL') AND gold_corruption")
def contradictory_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.contradictory_approvals(metrics_of(spark, sf_dir))


def _contrast(spark: SparkSession, sf_dir: str, metric: str = "action_correct") -> DataFrame:
    return statistics.contrast(metrics_of(spark, sf_dir), metrics_of(spark, sf_dir, True), metric, ["lineage_group"])


_DIFF = _HV + ", x AS (SELECT h.lineage_group, h.action_correct::INT AS a, v.action_correct::INT AS b, v.action_correct::INT - h.action_correct::INT AS d FROM h JOIN v USING (case_id)) "


_MEASURES = ("action_correct", "label_correct", "case_success")
#: P(|T| < mid) for df degrees of freedom, a whole number: a finite sum over powers of the cosine of atan(mid / sqrt(df)).
_WITHIN = """CASE WHEN df % 2 = 1 THEN 2 / pi() * (atan(mid / sqrt(df)) + CASE WHEN df = 1 THEN 0 ELSE sin(atan(mid / sqrt(df))) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * cos(atan(mid / sqrt(df))) ^ (2 * j + 1))) END)
 ELSE sin(atan(mid / sqrt(df))) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * cos(atan(mid / sqrt(df))) ^ (2 * j))) END"""
_T = f"list_reduce(list_transform(range(0, 61), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 1000.0::DOUBLE}}), lambda s, i: CASE WHEN {_WITHIN.replace('mid', '((s.lo + s.hi) / 2)')} < 0.95 THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END).lo"


@query(_HV + ", x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, h.lineage_group, v.{m}::INT - h.{m}::INT AS d FROM h JOIN v USING (case_id)" for m in _MEASURES) + f""" ),
s AS (SELECT metric, lineage_group, count(*) AS n, sum(d) AS t FROM x GROUP BY 1, 2), w AS (SELECT metric, sum(n) AS n, count(*) AS g, sum(t) / sum(n)::DOUBLE AS m FROM s GROUP BY 1),
e AS (SELECT metric, w.n::BIGINT AS n, g AS clusters, g - 1 AS df, m AS estimate, sqrt(g / (g - 1)::DOUBLE * sum((s.t - s.n * m) ^ 2) / w.n::DOUBLE ^ 2) AS se FROM s JOIN w USING (metric) GROUP BY metric, w.n, g, m),
q AS (SELECT *, {_T} AS t FROM e)
SELECT metric, n, clusters, round(estimate, 6) AS estimate, round(se, 6) AS se, df, round(estimate - t * se, 6) AS ci_low, round(estimate + t * se, 6) AS ci_high FROM q""")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three metrics of two arms compared case by case, with intervals over clusters."""
    found = None
    for m in _MEASURES:
        one = statistics.cluster_se(_contrast(spark, sf_dir, m), "lineage_group").withColumn("metric", F.lit(m))
        found = one if found is None else found.unionByName(one)
    return _r(statistics.interval(found))


def case_table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the visible arm's cases, with what its run tells."""
    d, n = F.col("doc_id"), F.col("n_chars")
    words = lambda w: F.array(*map(F.lit, w)).cast("array<string>")
    run = {
        "base_artifact": F.concat(F.lit("doc_"), d.cast("string")), "model_path": F.lit("model"), "condition": F.lit("visible"), "run_seed": d % 3, "excluded_tools": F.when(d % 5 == 0, words(["check_lineage"])),
        "unresolved": F.when(n % 2 == 0, words(["a", "b"])), "inference_seconds": F.when(d % 4 != 0, n / 1000), "input_tokens": n, "output_tokens": F.when(d % 3 != 0, d),
    }
    return score.case_table(metrics_of(spark, sf_dir, True).withColumns(run))


_EVENT = lambda e: f"len(list_filter(history, lambda x: x = '{e}'))"
_RUN_SQL = {
    "base_artifact": "'doc_' || doc_id", "pred_action": "action", "pred_label": "label", "model_path": "'model'", "condition": "'visible'", "run_seed": "doc_id % 3", "excluded_tools": """CASE WHEN doc_id % 5 = 0 THEN '["check_lineage"]' ELSE '[]' END""",
    "unresolved_n": "CASE WHEN n_chars % 2 = 0 THEN 2 ELSE 0 END::BIGINT", "inference_seconds": "CASE WHEN doc_id % 4 <> 0 THEN n_chars / 1000 ELSE 0 END::DOUBLE", "input_tokens": "n_chars", "output_tokens": "CASE WHEN doc_id % 3 <> 0 THEN doc_id ELSE 0 END::BIGINT",
    **{k: _EVENT(e) for k, e in score.EVENTS.items()},
}
_TABLE = _V + ", full_table AS (SELECT " + ", ".join(f"{_RUN_SQL[c]} AS {c}" if c in _RUN_SQL else c for c in score.CASE_COLUMNS) + " FROM v) "


@query(_TABLE + "SELECT * FROM full_table")
def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_table_of(spark, sf_dir)


_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("inference_seconds", "input_tokens", "output_tokens"))


@query(_TABLE + " UNION ALL ".join(f"SELECT {d} AS dimension, {v} AS value, {_SUMMARY}, {_MEANS} FROM full_table GROUP BY 1, 2" for d, v in (("'all'", "NULL"), *((f"'{k}'", k) for k in ("condition", "task", "base_artifact")))))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen metrics over all cases, by condition, by task and by artifact."""
    return _r(score.grouped_summaries(case_table_of(spark, sf_dir), ["condition", "task", "base_artifact"], runs=True))


@query(_DIFF + "SELECT lineage_group, count(*) AS n, sum(d)::DOUBLE AS total FROM x GROUP BY 1")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cluster_scores(_contrast(spark, sf_dir), "lineage_group")


@query(_DIFF + """, c AS (SELECT count(*) FILTER (a > b) AS l, count(*) FILTER (a < b) AS r FROM x)
SELECT l AS left_only, r AS right_only, round(CASE WHEN l + r = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(l, r) + 1), lambda i: exp(lgamma(l + r + 1) - lgamma(i + 1) - lgamma(l + r - i + 1) - (l + r) * ln(2))))) END, 9)::DOUBLE AS p FROM c""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mcnemar(_contrast(spark, sf_dir)).withColumn("p", F.round("p", 9))


# --- typed cases for the gate and the rule system

_NAMES = ["SubjectID", "Age", "SexCode", "DX", "panss_total", "cpz", "dose_mg", "foo"]
_CONCEPTS = ["subject_identifier", "current_age", "unknown_or_study_specific", "diagnosis", "panss_total", "cpz_candidate", "medication_dose", "unknown_or_study_specific"]


def typed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with observations and evidence that documents decide by their ids and lengths."""
    rows = panel_cases_of(spark, sf_dir).select("case_id", "study", "task", "error_family", "lineage_group", "doc_id", "n_chars", "source")
    d, n, t = F.floor(F.col("doc_id") / 5), F.col("n_chars"), F.col("task")
    words = lambda w: F.array(*map(F.lit, w))
    pick = lambda w, k: F.get(words(w), (k % len(w)).cast("int"))
    null = F.lit(None)
    right = F.create_map(F.lit("1"), F.lit("SZ"), F.lit("2"), F.lit("HC"))
    wrong = F.create_map(F.lit("1"), F.lit("HC"), F.lit("2"), F.lit("SZ"))
    only = lambda task, value: F.when(t == task, value)
    obs = F.struct(
        only("T-FILE", F.concat_ws(" ", "source", pick(["panss clinical", "demographics", "codebook"], d))).alias("artifact_name"),
        only("T-COL", pick(_NAMES, d)).alias("column_name"),
        only("T-FILE", F.when(d % 6 == 0, "injected_parser_failure").otherwise("parsed")).alias("parser_status"),
        only("T-FILE", F.lit("clinical_scale")).alias("proposed_role"),
        only("T-COL", F.lit("current_age")).alias("proposed_concept"),
        only("T-VAL", right).alias("proposed_mapping"),
        only("T-ID", pick([None, "identifier_linkage", "source_independence"], d)).alias("id_scope"),
        only("T-ID", F.lit("partial_overlap")).alias("proposed_relationship"),
        only("T-ID", d % 2 == 1).alias("proposed_identity_proven"),
        only("T-ID", F.lit("nonindependent_same_lineage")).alias("proposed_independence"),
        only("T-GOV", F.lit("release_policy")).alias("governance_scope"),
    )
    evidence = F.struct(
        F.when((t == "T-FILE") & (n % 11 == 0), "parser_failure").otherwise("parsed").alias("status"),
        null.cast("array<string>").alias("column_names"),
        null.cast("array<string>").alias("sheet_names"),
        only("T-VAL", F.when(n % 2 == 0, right).otherwise(wrong)).alias("mapping"),
        only("T-ID", n % 2 == 0).alias("order_agreement"),
        only("T-ID", F.when(n % 2 == 0, F.lit(0)).otherwise(F.lit(8)).cast("bigint")).alias("mismatch_n"),
        only("T-ID", F.lit(157).cast("bigint")).alias("imaging_n"),
        only("T-ID", F.when(n % 3 == 0, "left_complete_subset").otherwise("partial_overlap")).alias("relationship"),
        only("T-ID", n % 4 != 0).alias("same_lineage"),
        only("T-ID", F.when(n % 4 != 0, "nonindependent_same_lineage").otherwise("independent_distinct_lineage")).alias("independence"),
    )
    tools = F.when((t == "T-COL") & (d % 2 == 0), words(["profile_values"])).when((t == "T-VAL") & (d % 3 != 0), words(["get_dictionary_entry"])).otherwise(F.array().cast("array<string>"))
    return rows.select("case_id", "study", "task", "error_family", "lineage_group", "doc_id", "n_chars", obs.alias("obs"), evidence.alias("evidence"), tools.alias("tools"))


_LIST = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
RULES = f"""c AS (SELECT p.*, (doc_id // 5) AS k FROM p),
f AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'clinical_scale' WHEN k % 3 = 1 THEN 'demographics' ELSE 'dictionary_or_codebook' END AS role, {_LIST(_CONCEPTS)}[(k % 8 + 1)::INT] AS concept, [NULL, 'identifier_linkage', 'source_independence'][(k % 3 + 1)::INT] AS scope,
 CASE WHEN n_chars % 2 = 0 THEN '{{"1":"SZ","2":"HC"}}' ELSE '{{"1":"HC","2":"SZ"}}' END AS mapping, CASE WHEN n_chars % 3 = 0 THEN 'left_complete_subset' ELSE 'partial_overlap' END AS relation, CASE WHEN n_chars % 4 <> 0 THEN 'nonindependent_same_lineage' ELSE 'independent_distinct_lineage' END AS status FROM c),
r AS (SELECT *, CASE task WHEN 'T-FILE' THEN role WHEN 'T-COL' THEN concept WHEN 'T-VAL' THEN 'value_encoding' WHEN 'T-ID' THEN coalesce(scope, 'imaging_row_alignment') ELSE 'release_policy' END AS rule_label,
 CASE WHEN task = 'T-GOV' THEN 'escalate' WHEN task = 'T-FILE' THEN CASE WHEN n_chars % 11 = 0 THEN 'abstain' WHEN role = 'clinical_scale' THEN 'accept_provisionally' ELSE 'recover' END WHEN task = 'T-COL' THEN CASE WHEN concept = 'current_age' THEN 'accept_provisionally' ELSE 'recover' END
  WHEN task = 'T-VAL' THEN CASE WHEN k % 3 = 0 THEN 'abstain' WHEN n_chars % 2 = 0 THEN 'accept_provisionally' ELSE 'recover' END WHEN scope IS NULL THEN CASE WHEN n_chars % 2 = 0 THEN 'accept_provisionally' ELSE 'recover' END
  WHEN scope = 'identifier_linkage' THEN CASE WHEN relation = 'partial_overlap' AND k % 2 = 0 THEN 'accept_provisionally' ELSE 'recover' END ELSE CASE WHEN status = 'nonindependent_same_lineage' THEN 'accept_provisionally' ELSE 'recover' END END AS rule_action,
 CASE task WHEN 'T-FILE' THEN CASE WHEN k % 6 = 0 THEN '{{"parser_status":"parsed","primary_role":"' || role || '"}}' ELSE '{{"primary_role":"' || role || '"}}' END WHEN 'T-COL' THEN '{{"concept":"' || concept || '"}}' WHEN 'T-VAL' THEN '{{"mapping":' || mapping || '}}'
  WHEN 'T-ID' THEN CASE WHEN scope IS NULL THEN '{{"operation":"restore_analysis_id_order"}}' WHEN scope = 'identifier_linkage' THEN '{{"identity_proven":false,"relationship":"' || relation || '"}}' ELSE '{{"independence_status":"' || status || '"}}' END END AS fix,
 CASE WHEN task <> 'T-COL' THEN 1 WHEN concept IN ('diagnosis', 'current_age', 'medication_dose') OR (concept = 'unknown_or_study_specific' AND k % 2 = 0) THEN 1 ELSE 0 END AS calls FROM f)"""


@query(f"WITH {PANEL}, {RULES} SELECT case_id, rule_action AS action, rule_label AS label, CASE WHEN rule_action = 'recover' THEN fix END AS repair, calls::BIGINT AS calls FROM r")
def deterministic_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.rule_system(typed_cases(spark, sf_dir))
    return found.select("case_id", "action", "label", "repair", F.size("called").cast("bigint").alias("calls"))


def raw_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw decisions to be gated: an action by length, a fixed label, and tools by id."""
    n, d = F.col("n_chars"), F.col("doc_id")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    return typed_cases(spark, sf_dir).withColumns(
        {
            "raw_action": F.get(F.array(*map(F.lit, ("recover", "accept_provisionally", "abstain", "escalate", "commit"))), (n % 5).cast("int")),
            "raw_label": F.when(n % 2 == 0, "diagnosis").otherwise("mixed"),
            "raw_repair": F.lit('{"x":1}'),
            "called": F.when(d % 2 == 0, words()).otherwise(words("reparse_artifact", "profile_values", "get_dictionary_entry", "check_id_overlap", "escalate_to_human")),
        }
    )


@query(f"""WITH {PANEL}, {RULES},
n AS (SELECT *, doc_id % 2 = 1 AS tooled, CASE n_chars % 5 WHEN 0 THEN 'recover' WHEN 1 THEN 'accept_provisionally' WHEN 3 THEN 'escalate' ELSE 'abstain' END AS a, CASE WHEN task IN ('T-FILE', 'T-COL') THEN CASE WHEN n_chars % 2 = 0 THEN 'diagnosis' ELSE 'mixed' END ELSE rule_label END AS l FROM r),
w AS (SELECT *, CASE WHEN task = 'T-GOV' THEN CASE WHEN a <> 'escalate' THEN 'governance must be escalated' WHEN NOT tooled THEN 'escalation without escalate_to_human' END WHEN a NOT IN ('recover', 'accept_provisionally') THEN NULL
 WHEN task = 'T-FILE' AND NOT tooled THEN 'file role without reparse_artifact' WHEN task = 'T-COL' AND l = 'diagnosis' AND NOT tooled THEN 'sensitive concept without profile_values' WHEN task = 'T-VAL' AND NOT tooled THEN 'value encoding without a verifier'
 WHEN task = 'T-ID' AND scope IS NULL THEN 'imaging_row_alignment without check_imaging_order' WHEN task = 'T-ID' AND scope = 'source_independence' THEN 'source_independence without check_lineage' WHEN task = 'T-ID' AND NOT tooled THEN 'identifier_linkage without check_id_overlap' END AS violation FROM n)
SELECT case_id, violation, violation IS NULL AS authorized, CASE WHEN violation IS NULL THEN a WHEN task = 'T-GOV' THEN 'escalate' ELSE 'abstain' END AS action, CASE WHEN violation IS NULL OR task NOT IN ('T-FILE', 'T-COL') THEN l END AS label,
 CASE WHEN violation IS NULL AND a = 'recover' THEN CASE task WHEN 'T-FILE' THEN CASE WHEN k % 6 = 0 AND tooled THEN '{{"parser_status":"parsed","primary_role":"' || l || '"}}' ELSE '{{"primary_role":"' || l || '"}}' END WHEN 'T-COL' THEN '{{"concept":"' || l || '"}}' WHEN 'T-ID' THEN CASE WHEN scope = 'source_independence' THEN '{{"x":1}}' ELSE fix END ELSE '{{"x":1}}' END END AS repair FROM w""")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gated(raw_decisions(spark, sf_dir)).select("case_id", "violation", "authorized", "action", "label", "repair")


@query(f"""WITH {PANEL}, {RULES},
m AS (SELECT *, CASE WHEN task = 'T-ID' AND scope IS NULL THEN 'T-ID:imaging_order' WHEN task = 'T-ID' AND scope = 'identifier_linkage' THEN 'T-ID:linkage' WHEN task = 'T-ID' THEN 'T-ID:lineage' WHEN task = 'T-VAL' AND k % 3 <> 0 THEN 'T-VAL:encoding' WHEN task = 'T-FILE' AND k % 6 = 0 THEN 'T-FILE:parser' END AS family,
 CASE WHEN relation = 'partial_overlap' THEN 'left_complete_subset' ELSE 'partial_overlap' END AS relation2 FROM r),
q AS (SELECT *, CASE family WHEN 'T-ID:imaging_order' THEN (n_chars % 2 = 0) = false WHEN 'T-ID:linkage' THEN relation2 = 'partial_overlap' AND k % 2 = 0 WHEN 'T-ID:lineage' THEN n_chars % 4 = 0 WHEN 'T-VAL:encoding' THEN n_chars % 2 = 1 ELSE false END AS ok2 FROM m WHERE family IS NOT NULL),
z AS (SELECT unnest(CASE WHEN family = 'T-FILE:parser' THEN ['all', family] ELSE ['all', 'mechanistic', family] END) AS fam, *, CASE WHEN family = 'T-FILE:parser' THEN 'abstain' WHEN ok2 THEN 'accept_provisionally' ELSE 'recover' END AS action2 FROM q),
s AS (SELECT fam AS family, unnest(['deterministic_reference', 'frozen_answer']) AS system, action2, rule_action, family AS own, n_chars, fix, relation2 FROM z),
k2 AS (SELECT system, family, CASE WHEN system = 'deterministic_reference' THEN true ELSE rule_action = action2 AND (action2 <> 'recover' OR own = 'T-ID:imaging_order') END AS m FROM s)
SELECT system, family, count(*) AS n, count(*) FILTER (m) AS correct_correct, count(*) FILTER (NOT m) AS correct_wrong, 0::BIGINT AS wrong_correct, 0::BIGINT AS wrong_wrong, round(avg(m::INT), 6) AS cec, 1.0::DOUBLE AS original_side, round(avg(m::INT), 6) AS mutated_side FROM k2 GROUP BY ALL""")
def cec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = typed_cases(spark, sf_dir)
    oracle = gate.rule_system(cases).select("case_id", F.col("action").alias("gold_action"), F.col("repair").alias("gold_repair"))
    return _r(cec.cells(cases, oracle))


_GRID = [(rate, seed) for rate in (0.0, 0.05, 0.1, 0.25, 0.5) for seed in (11, 29, 47)]


@query(" UNION ALL ".join(f"SELECT {rate}::DOUBLE AS rate, {seed} AS seed, count(*) AS n, round_even({rate} * count(*), 0)::BIGINT AS chosen, CASE WHEN round_even({rate} * count(*), 0) > 1 THEN round_even({rate} * count(*), 0)::BIGINT ELSE 0 END AS moved, count(*) AS overlap_n FROM documents" for rate, seed in _GRID))
def order_corruption_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("key"))
    return panel.corruption_grid(keys, _GRID)




@query(f"""WITH {PANEL}, {RULES}, w AS (SELECT *, CASE task WHEN 'T-FILE' THEN 'reparse_artifact' WHEN 'T-VAL' THEN CASE WHEN k % 3 <> 0 THEN 'get_dictionary_entry' ELSE 'profile_values' END
 WHEN 'T-ID' THEN CASE WHEN scope = 'identifier_linkage' THEN 'check_id_overlap' WHEN scope = 'source_independence' THEN 'check_lineage' ELSE 'check_imaging_order' END WHEN 'T-GOV' THEN 'escalate_to_human' ELSE 'profile_values' END AS tool FROM r)
SELECT case_id, '{{"action":"' || rule_action || '","evidence_tools":[' || CASE WHEN calls = 1 THEN '"' || tool || '"' ELSE '' END || '],"label":"' || rule_label || '","unresolved":[]}}' AS decision FROM w""")
def decision_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' decisions as envelopes, without their repairs."""
    found = gate.rule_system(typed_cases(spark, sf_dir))
    return found.select("case_id", F.to_json(S.envelope(F.col("action"), F.col("label"), F.lit(None).cast("string"), F.col("called"))).alias("decision"))
