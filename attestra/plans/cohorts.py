"""Queries on feature matrices and cohort bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, effects
from ..session import table
from .registry import query


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with label 1 as cases; age, sex and site by position."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.when(F.col("label") == 1, 1).otherwise(2).alias("diagnosis"),
        (20 + v % 50).cast("double").alias("age"), (1 + v % 2).cast("int").alias("sex"), F.col("label").alias("site"),
    )


@query("""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id AS pos, count(*) AS features_n, round(sum(v), 6) AS total, round(sum(v * (k // 8) * 10 + v * (k % 8)), 6) AS weighted, CASE WHEN any_value(label) = 1 THEN 1 ELSE 2 END AS diagnosis, (20 + vec_id % 50)::DOUBLE AS age, (1 + vec_id % 2)::INTEGER AS sex,
 CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE any_value(label) END::DOUBLE AS site FROM x JOIN embeddings USING (vec_id) WHERE k // 8 > k % 8 GROUP BY vec_id""")
def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as matrices of 8 by 8, and scores under headers in an order of their own; some have no site."""
    v = F.col("vec_id")
    cells = table(spark, sf_dir, "embeddings").select(v.alias("pos"), F.posexplode("embedding").alias("k", "value"))
    matrices = cells.select("pos", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.col("value").cast("double").alias("value"))
    h = effects.HEADERS
    fields, values = [h["sex"], h["diagnosis"] + "1:SZ; 2:HC)", h["age"]], [1 + v % 2, F.when(F.col("label") == 1, 1).otherwise(2), 20 + v % 50]
    some = v % 3 == 0
    names, given = F.array(*map(F.lit, fields)), F.array(*[x.cast("double") for x in values])
    scores = table(spark, sf_dir, "embeddings").select(
        v.alias("pos"), F.when(some, names).otherwise(F.concat(F.array(F.lit(h["site"])), names)).alias("fields"), F.when(some, given).otherwise(F.concat(F.array(F.col("label").cast("double")), given)).alias("values")
    )
    found = effects.load_cohort(matrices, scores)
    places = F.array(*[F.lit(10 * i + j) for i in range(8) for j in range(i)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return _r(found.select("pos", F.size("features").cast("bigint").alias("features_n"), total(F.col("features")).alias("total"), total(F.zip_with("features", places, lambda x, w: x * w)).alias("weighted"), "diagnosis", "age", "sex", "site"))


_X = "x AS (SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _smd(label: int, sign: str = "", where: str = "true") -> str:
    return f"""SELECT feature, CASE WHEN pooled > 0 THEN {sign}(m1 - m0) / pooled ELSE 0 END AS effect FROM (SELECT feature, m1, m0, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS pooled FROM (SELECT feature, count(*) FILTER (label = {label}) AS n1, count(*) FILTER (label <> {label}) AS n0,
avg(x) FILTER (label = {label}) AS m1, avg(x) FILTER (label <> {label}) AS m0, var_samp(x) FILTER (label = {label}) AS v1, var_samp(x) FILTER (label <> {label}) AS v0 FROM x WHERE {where} GROUP BY feature))"""


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


@query(f"WITH {_X} SELECT feature, round(effect, 6) AS effect FROM ({_smd(1)})")
def smd_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(effects.smd(cohort(spark, sf_dir)))


@query(f"WITH {_X} SELECT feature, round(effect, 6) AS effect FROM ({_smd(1, '-')})")
def label_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label inversion of all rows: every effect changes its sign."""
    rows = cohort(spark, sf_dir).withColumns({"rate": F.lit(1.0), "seed": F.lit(7)})
    turned = effects.label_inversion(rows, ["rate", "seed"]).drop("diagnosis").withColumnRenamed("new_diagnosis", "diagnosis")
    return _r(effects.smd(turned))


@query(f"""WITH {_X}, r AS (SELECT feature, x, label = 1 AS y, (rank() OVER (PARTITION BY feature ORDER BY x) + rank() OVER (PARTITION BY feature ORDER BY x) + count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM x)
SELECT feature, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6)::DOUBLE AS auc FROM r GROUP BY feature""")
def auc_per_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = effects.long(cohort(spark, sf_dir).withColumn("y", (F.col("diagnosis") == 1).cast("int")), "y")
    return _r(effects.auc(rows, ["feature"]))


@query(f"""WITH {_X}, b AS (SELECT a.feature, a.effect AS a, b.effect AS b FROM ({_smd(1)}) a JOIN ({_smd(2)}) b USING (feature)),
t AS (SELECT *, row_number() OVER (ORDER BY abs(a) DESC, feature) <= 20 AS ta, row_number() OVER (ORDER BY abs(b) DESC, feature) <= 20 AS tb FROM b)
SELECT round(corr(a, b), 6) AS correlation, round(sqrt(avg((a - b) ^ 2)), 6) AS rmse, round(avg((sign(a) <> sign(b))::INT) FILTER (abs(a) > 1e-12 OR abs(b) > 1e-12), 6) AS sign_flip_rate, round(count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb)::DOUBLE, 6) AS top_k_jaccard FROM t""")
def effect_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cohort(spark, sf_dir)
    other = one.withColumn("diagnosis", F.when(F.col("site") == 2, 1).otherwise(2))
    return _r(effects.compare(effects.smd(one), effects.smd(other), top=20))


_GRID = [(rate, seed) for rate in (0.0, 0.05, 0.1, 0.25, 0.5) for seed in (11, 29)]


@query(" UNION ALL ".join(f"SELECT {r}::DOUBLE AS rate, {s} AS seed, count(*) AS n, round_even({r} * count(*), 0)::BIGINT AS chosen, sum(label = 1)::BIGINT AS cases, round(avg(20 + vec_id % 50), 6) AS mean_age FROM embeddings" for r, s in _GRID))
def row_order_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint row-order corruption moves covariates but keeps each one's distribution."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(s).alias("seed")) for r, s in _GRID])).alias("c")
    rows = cohort(spark, sf_dir)
    rows = rows.select("*", cells).select(*rows.columns, "c.rate", "c.seed")
    done = effects.row_order(rows, ["rate", "seed"])
    return _r(done.groupBy("rate", "seed").agg(F.count("*").alias("n"), F.max("k").alias("chosen"), F.count_if(F.col("new_diagnosis") == 1).alias("cases"), F.avg("new_age").alias("mean_age")))


@query()
def adjusted_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(effects.adjusted_coefficient(cohort(spark, sf_dir)))


@query()
def cv_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(effects.auc(effects.cross_validated(cohort(spark, sf_dir), F.lit(101))))


@query()
def sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effects.sensitivity(cohort(spark, sf_dir), _GRID)
    return _r(effects.summarize(found, ["family", "rate"], ["changed_n", *effects.METRICS, "adjusted_correlation", "adjusted_rmse"]))


@query()
def downstream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What metadata corruption costs a classifier: all models of the whole grid are fitted together."""
    found = effects.sensitivity(cohort(spark, sf_dir), _GRID, aucs=True)
    return _r(effects.downstream_report(effects.summarize(found, ["family", "rate"], ["altered_auc", "auc_delta"])))


@query()
def bundle_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 1 and 2 as a bundle's diagnoses against the reference, with the AUC of the labelled rows."""
    labelled = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("diagnosis"))
    return _r(effects.evaluate_bundle(labelled, cohort(spark, sf_dir)))


@query("SELECT count(*) AS n, count(*) FILTER (label IN (1, 2)) AS labelled_n, round(avg((label IN (1, 2))::INT), 6) AS coverage, count(*) FILTER (label = 1 OR label = 2) AS agree_n, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (label = 2) AS class_2 FROM embeddings")
def bundle_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("diagnosis"))
    return _r(effects.evaluate_labels(labelled, cohort(spark, sf_dir).withColumn("diagnosis", F.col("site"))))


# --- bundles: customers as subjects, suppliers (some twice) as their source

_CODES = {"sex": {"1": "male", "2": "female"}, "diagnosis": {"1": "case", "2": "control"}}


def bundle_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    subjects = c.select(
        F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("analysis_id"), F.floor(F.abs("c_acctbal")).alias("age"),
        (F.col("c_nationkey") % 2 + 1).cast("string").alias("sex"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "1").when(F.col("c_mktsegment") == "MACHINERY", "0").otherwise("2").alias("diagnosis"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("s_suppkey") % 10 == 0, 2).otherwise(1)))
    age = F.when(F.col("s_suppkey") % 3 == 0, F.lit(0)).otherwise(F.floor(F.abs("s_acctbal")))
    source = s.select("*", copies.alias("copy")).join(c.select("c_custkey", "c_acctbal", "c_nationkey"), F.col("s_suppkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("00"), F.col("s_suppkey").cast("string")).alias("key"),
        F.when(F.col("s_suppkey") % 2 == 0, age).otherwise(F.floor(F.abs("c_acctbal"))).alias("age"),
        (F.col("c_nationkey") % 2 + 1).cast("string").alias("sex"), F.lit("2").alias("diagnosis"),
    )
    return bundle.canonical(subjects, source, "ALPHA", "pepper", _CODES)


_BUNDLE = """s AS (SELECT c_custkey AS pos, floor(abs(c_acctbal))::BIGINT AS age, (c_nationkey % 2 + 1)::VARCHAR AS sex, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '1' WHEN 'MACHINERY' THEN '0' ELSE '2' END AS dx, c_acctbal FROM customer),
q AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE floor(abs(s_acctbal))::BIGINT END ELSE floor(abs(c_acctbal))::BIGINT END AS age, (c_nationkey % 2 + 1)::VARCHAR AS sex FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey),
j AS (SELECT s.*, q.n, q.age AS qage, q.sex AS qsex, coalesce(n = 1 AND s.age <> q.age, false) AS conflict_age, coalesce(n = 1 AND s.sex IS DISTINCT FROM q.sex, false) AS conflict_sex, coalesce(n = 1 AND s.dx <> '2', false) AS conflict_diagnosis FROM s LEFT JOIN q ON q.k = s.pos),
b AS (SELECT 'alpha_' || substr(sha256('pepper|ALPHA|' || pos::VARCHAR), 1, 20) AS subject_key, 'ALPHA' AS study, pos, age::VARCHAR AS age, CASE sex WHEN '1' THEN 'male' ELSE 'female' END AS sex, CASE dx WHEN '1' THEN 'case' WHEN '2' THEN 'control' ELSE 'UNRESOLVED:' || dx END AS diagnosis,
 CASE WHEN n = 1 THEN qage::VARCHAR END AS source_age, CASE WHEN n = 1 THEN qsex END AS source_sex, CASE WHEN n = 1 THEN '2' END AS source_diagnosis, conflict_age, conflict_sex, conflict_diagnosis,
 CASE WHEN n IS NULL THEN 'not_in_source_table' WHEN n > 1 THEN 'ambiguous_duplicate_source_key' WHEN conflict_age OR conflict_sex OR conflict_diagnosis THEN 'matched_source_conflict_review' ELSE 'matched_verified' END AS source_join_status FROM j)"""
_SUM = """m AS (SELECT study, count(*) AS subjects, count(*) FILTER (source_join_status LIKE 'matched%') AS matched, count(*) FILTER (source_join_status = 'not_in_source_table') AS missing, count(*) FILTER (source_join_status = 'ambiguous_duplicate_source_key') AS duplicate,
 count(*) FILTER (conflict_age) AS conflict_age, count(*) FILTER (conflict_sex) AS conflict_sex, count(*) FILTER (conflict_diagnosis) AS conflict_diagnosis, count(*) FILTER (diagnosis IN ('0', '-1')) AS other_diagnosis FROM b GROUP BY study)"""


@query(f"WITH {_BUNDLE} SELECT * FROM b")
def bundle_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle_of(spark, sf_dir)


@query(f"WITH {_BUNDLE}, {_SUM} SELECT * FROM m")
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.study_summary(bundle_of(spark, sf_dir))


@query(f"WITH {_BUNDLE} " + " UNION ALL ".join(f"SELECT study, '{f}' AS field, '{a}' AS artifact, '{r}' AS rule, count(*) FILTER (coalesce({f}::VARCHAR, '') <> '') AS available_n FROM b GROUP BY study" for f, a, r in [*((x, "customer", "canonical_value") for x in ("age", "sex", "diagnosis")), *((f"source_{x}", "supplier", "unique_key_lookup") for x in ("age", "sex", "diagnosis")), ("subject_key", "customer", "salted_digest")]))
def bundle_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.provenance(bundle_of(spark, sf_dir), "customer", "supplier")


@query(f"""WITH {_BUNDLE}, {_SUM}, u AS (SELECT study, unnest([{{'issue': 'source_coverage', 'n': missing, 'severity': 'medium'}}, {{'issue': 'duplicate_source_keys', 'n': duplicate, 'severity': 'high'}}, {{'issue': 'age_conflict', 'n': conflict_age, 'severity': 'medium'}}, {{'issue': 'sex_conflict', 'n': conflict_sex, 'severity': 'medium'}},
 {{'issue': 'diagnosis_conflict', 'n': conflict_diagnosis, 'severity': 'high'}}, {{'issue': 'segment_semantics', 'n': matched, 'severity': 'medium'}}, {{'issue': 'non_analysis_diagnosis_codes', 'n': other_diagnosis, 'severity': 'medium'}}, {{'issue': 'dose_conversion_policy', 'n': subjects, 'severity': 'high'}}, {{'issue': 'site_missing', 'n': subjects, 'severity': 'medium'}}]) AS x FROM m)
SELECT study, x.issue AS issue, x.n AS affected_n, x.severity AS severity FROM u WHERE x.n > 0 OR x.issue IN ('segment_semantics', 'dose_conversion_policy', 'site_missing')""")
def bundle_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.unresolved(bundle.study_summary(bundle_of(spark, sf_dir)), semantics=["segment"])


@query("""WITH c AS (SELECT lang AS study, source AS column_name, CASE WHEN n_chars % 2 = 0 THEN ['current_age', 'diagnosis', 'panss_total'][(doc_id % 3 + 1)::INT] END AS label FROM documents),
w AS (SELECT DISTINCT study, unnest(['current_age', 'diagnosis', 'sex_or_gender']) AS target FROM c), h AS (SELECT study, label AS target, count(*) AS n, min(column_name) AS f FROM c WHERE label IS NOT NULL GROUP BY ALL)
SELECT study, target, CASE WHEN n = 1 THEN f END AS column_name, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS state FROM w LEFT JOIN h USING (study, target)""")
def mapping_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, ("current_age", "diagnosis", "panss_total"))), (F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "documents")
    decided = rows.select(
        F.col("lang").alias("study"), F.col("source").alias("column_name"), F.lit(True).alias("parse_success"), F.lit("accept_provisionally").alias("action"), label.alias("label"),
        F.when(F.col("n_chars") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("open"))).alias("unresolved"),
    )
    return bundle.derive_mappings(bundle.selected_decisions(decided, True), ["current_age", "diagnosis", "sex_or_gender"])


# --- an agent's bundle: customers as subjects, suppliers' columns as decisions chose them

_MAPPED = {"subject_identifier": "key", "current_age": "balance", "sex_or_gender": "code"}


def _agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    subjects = c.select(
        F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("analysis_id"), F.floor(F.abs("c_acctbal")).alias("age"), (F.col("c_nationkey") % 2 + 1).cast("string").alias("sex"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "1").otherwise("2").alias("diagnosis"), F.col("c_nationkey").alias("site"), F.array(F.col("c_acctbal"), F.when(F.col("c_custkey") % 7 != 0, F.lit(1.0)).otherwise(F.lit(float("nan")))).alias("features"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("s_suppkey") % 10 == 0, 2).otherwise(1)))
    source = s.select(F.concat(F.lit("00"), F.col("s_suppkey").cast("string")).alias("key"), F.floor(F.abs("s_acctbal")).alias("balance"), (F.col("s_nationkey") % 3).cast("string").alias("code"), copies.alias("copy"))
    return bundle.agent_bundle(subjects, source, _MAPPED, "ALPHA", "supplier", "pepper", _CODES)


_AGENT = """q AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS n, floor(abs(s_acctbal))::BIGINT::VARCHAR AS balance, CASE s_nationkey % 3 WHEN 0 THEN 'UNRESOLVED:0' WHEN 1 THEN 'male' ELSE 'female' END AS code FROM supplier),
a AS (SELECT 'ALPHA' AS cohort, 'alpha_' || substr(sha256('pepper|ALPHA|' || c_custkey::VARCHAR), 1, 20) AS subject_key, CASE WHEN n = 1 THEN balance ELSE '' END AS age, CASE WHEN n = 1 THEN code ELSE '' END AS sex, '' AS diagnosis, c_nationkey::VARCHAR AS site, 'exact_id_order' AS bridge_status,
 CASE WHEN c_custkey % 7 <> 0 THEN 'yes' ELSE 'no' END AS sfnc_available, 'supplier' AS agent_source_artifact, CASE WHEN n = 1 THEN 'matched_unique' WHEN n > 1 THEN 'duplicate_key' ELSE 'not_in_source' END AS agent_join_status, floor(abs(c_acctbal))::BIGINT::VARCHAR AS analysis_reference_age,
 CASE c_nationkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS analysis_reference_sex, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'case' ELSE 'control' END AS analysis_reference_diagnosis, '' AS source_age, '' AS source_sex, '' AS source_diagnosis, '' AS source_panss_total, '' AS source_cminds_composite FROM customer LEFT JOIN q ON k = c_custkey)"""


@query(f"WITH {_AGENT} SELECT * FROM a")
def agent_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agent(spark, sf_dir)


@query(f"WITH {_AGENT} SELECT cohort, count(*) AS n_subjects, count(*) FILTER (agent_join_status = 'matched_unique') AS source_matched_n, count(*) FILTER (agent_join_status = 'duplicate_key') AS source_duplicate_n, count(*) FILTER (age <> '') AS age_coverage_n, count(*) FILTER (sex <> '') AS sex_coverage_n, count(*) FILTER (diagnosis <> '') AS diagnosis_coverage_n FROM a GROUP BY cohort")
def agent_bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.agent_summary(_agent(spark, sf_dir))


@query("""WITH c AS (SELECT lang AS study, CASE WHEN n_chars % 2 = 0 THEN ['current_age', 'diagnosis', 'panss_total'][(doc_id % 3 + 1)::INT] END AS label FROM documents),
w AS (SELECT DISTINCT study, unnest(['current_age', 'diagnosis', 'sex_or_gender']) AS target FROM c), h AS (SELECT study, label AS target, count(*) AS n FROM c WHERE label IS NOT NULL GROUP BY ALL)
SELECT study || '_' || target || '_mapping' AS issue_id, study AS cohort, target AS scope, (SELECT count(*) FROM customer) AS affected_n, 'documents' AS source_artifact, CASE WHEN target = 'diagnosis' THEN 'high' ELSE 'medium' END AS severity, 'human_review_or_add_evidence' AS action FROM w LEFT JOIN h USING (study, target) WHERE n IS DISTINCT FROM 1""")
def agent_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.agent_unresolved(mapping_ledger(spark, sf_dir), table(spark, sf_dir, "customer"), "documents")


@query("""SELECT doc_id, CASE WHEN raw THEN 'diagnosis' WHEN final IS NOT NULL THEN final END AS chosen_label, CASE WHEN raw THEN 'raw_candidate_ungated' WHEN final IS NOT NULL THEN 'terminal_fallback_ungated' ELSE 'no_candidate' END AS selection,
 CASE WHEN n_chars % 2 = 0 THEN final END AS gated_label FROM (SELECT doc_id, n_chars, doc_id % 4 = 1 AS raw, CASE WHEN doc_id % 3 <> 0 THEN 'current_age' END AS final FROM documents)""")
def ungated_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bundles would follow with and without the gate: raw outputs of prose, tools, candidates with and without a label, broken JSON."""
    k = F.col("doc_id")
    told = F.array(F.lit('{"type":"candidate","label":"diagnosis"}'), F.lit("prose"), F.lit('{"type":"tool","label":"panss_total"}'), F.lit('{"type":"decision","label":""}'))
    broken = F.array(F.lit('{"type":"candidate","label":"diagnosis"'), F.lit('{"label":"diagnosis"}'), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(True).alias("parse_success"), F.lit("recover").alias("action"), F.when(k % 3 != 0, "current_age").alias("label"),
        F.when(F.col("n_chars") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("open"))).alias("unresolved"), F.when(k % 4 == 1, told).when(k % 4 == 2, broken).alias("raw_outputs"),
    )
    gated = bundle.selected_decisions(rows, True).select("doc_id", F.col("chosen_label").alias("gated_label"))
    return bundle.selected_decisions(rows, False).select("doc_id", "chosen_label", "selection").join(gated, "doc_id")


@query("""WITH q AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS n, floor(abs(s_acctbal))::BIGINT AS age, s_nationkey % 3 AS sex, CASE WHEN s_suppkey % 4 = 0 THEN '1' ELSE '2' END AS dx, CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS panss FROM supplier),
j AS (SELECT *, CASE WHEN k % 2 = 0 THEN age ELSE floor(abs(c_acctbal))::BIGINT END AS given, c_nationkey % 2 + 1 AS own_sex, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '1' ELSE '2' END AS own_dx FROM customer LEFT JOIN q ON k = c_custkey)
SELECT 'ALPHA' AS cohort, 'alpha_' || substr(sha256('pepper|ALPHA|' || c_custkey::VARCHAR), 1, 20) AS subject_key, floor(abs(c_acctbal))::BIGINT::VARCHAR AS age, CASE own_sex WHEN 1 THEN 'male' ELSE 'female' END AS sex, CASE own_dx WHEN '1' THEN 'case' ELSE 'control' END AS diagnosis,
 c_nationkey::VARCHAR AS site, 'exact_id_order' AS bridge_status, 'exact_id_order' AS imaging_order_status, CASE WHEN c_custkey % 7 <> 0 THEN 'yes' ELSE 'no' END AS sfnc_available, 'supplier' AS clinical_source_artifact,
 CASE WHEN n IS NULL THEN 'not_in_source_table' WHEN n > 1 THEN 'ambiguous_duplicate_source_key' WHEN given <> floor(abs(c_acctbal))::BIGINT OR sex <> own_sex OR dx <> own_dx THEN 'matched_source_conflict_review' ELSE 'matched_verified' END AS clinical_source_join_status,
 CASE WHEN n = 1 THEN given::VARCHAR ELSE '' END AS source_age, CASE WHEN n = 1 THEN CASE sex WHEN 0 THEN 'UNRESOLVED:0' WHEN 1 THEN 'male' ELSE 'female' END ELSE '' END AS source_sex, CASE WHEN n = 1 THEN CASE dx WHEN '1' THEN 'case' ELSE 'control' END ELSE '' END AS source_diagnosis,
 CASE WHEN n = 1 THEN coalesce(panss::VARCHAR, '') ELSE '' END AS source_panss_total, '' AS source_cminds_composite FROM j""")
def bundle_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen columns of a bundle: customers as subjects in the order of a bridge, suppliers (some twice) as their clinical source."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    subjects = c.select(
        F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("analysis_id"), F.floor(F.abs("c_acctbal")).alias("age"), (F.col("c_nationkey") % 2 + 1).cast("string").alias("sex"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "1").otherwise("2").alias("diagnosis"), F.col("c_nationkey").alias("site"), F.array(F.col("c_acctbal"), F.when(F.col("c_custkey") % 7 != 0, F.lit(1.0)).otherwise(F.lit(float("nan")))).alias("features"),
    )
    k = F.col("s_suppkey")
    copies = F.explode(F.sequence(F.lit(1), F.when(k % 10 == 0, 2).otherwise(1))).alias("copy")
    source = s.join(c.select("c_custkey", "c_acctbal"), k == F.col("c_custkey"), "left").select(
        F.concat(F.lit("00"), k.cast("string")).alias("URSI"), F.when(k % 2 == 0, F.floor(F.abs("s_acctbal"))).otherwise(F.floor(F.abs("c_acctbal"))).alias("AGE"), (F.col("s_nationkey") % 3).cast("string").alias("GENDER"),
        F.when(k % 4 == 0, "1").otherwise("2").alias("DX"), F.when(k % 6 != 0, F.col("s_nationkey")).alias("PANSS"), copies,
    )
    names = {"key": "URSI", "age": "AGE", "sex": "GENDER", "diagnosis": "DX", "panss_total": "PANSS"}
    return bundle.whole(subjects, source, subjects.select("pos", "analysis_id"), names, "ALPHA", "supplier", "pepper", _CODES)
