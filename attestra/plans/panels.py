"""Case panels built from cards: documents as files, parts as columns, customers as linkages, suppliers as policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import evidence, panel
from ..session import table
from .registry import query

_POLICIES = ("diagnosis_inclusion_policy", "cpz_conversion_policy", "authoritative_source_selection", "construct_equivalence")


def _pick(words, k):
    return F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _case(column: str, choices: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items()) + f" ELSE {other} END"


def _id(*parts: str) -> str:
    return "substr(sha256(" + " || '|' || ".join(parts) + "), 1, 24)"


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("artifact_id"), F.col("lang").alias("study"), F.when(d % 3 == 0, "workbook").otherwise("table").alias("kind"), _pick(V.FILE_ROLES, d).alias("role"))


def columns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact_id"), F.col("p_type").alias("study"), F.col("p_size").cast("string").alias("sheet"), p.cast("string").alias("column_name"), _pick(V.COLUMN_CONCEPTS, p).alias("concept"))


def codes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    mapping = F.create_map(F.lit("1"), F.col("o_orderstatus"), F.lit("2"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(o.cast("string").alias("artifact_id"), F.lit("orders").alias("study"), F.lit("status").alias("column_name"), mapping.alias("mapping"), F.when(o % 2 == 0, "get_dictionary_entry").otherwise("compare_redundant_values").alias("reference"))


def cards_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.cast("string").alias("card_id"), F.col("c_mktsegment").alias("study"), _pick(tuple(V.OTHER_RELATIONSHIP), c).alias("relationship"), F.when(c % 5 == 0, c % 2 == 0).alias("order_agreement"))


def definitions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.cast("string").alias("artifact_id"), F.col("s_nationkey").cast("string").alias("study"), _pick(_POLICIES, s).alias("concept"), F.concat(F.lit("Treat "), "s_name", F.lit(" as decided.")).alias("proposal"), F.lit("Only people may decide this.").alias("reason"))


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region, each pair once."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_name").alias(x)) for x in ("left_member", "right_member"))
    return a.join(b, "n_regionkey").filter("left_member < right_member").select("left_member", "right_member")


_FILES = f"""f AS (SELECT doc_id::VARCHAR AS a, lang AS study, doc_id % 3 = 0 AS workbook, {_list(V.FILE_ROLES)}[(doc_id % {len(V.FILE_ROLES)} + 1)::INT] AS role FROM documents),
fc AS (SELECT *, unnest(['clean_role', 'role_misclassification', 'parser_failure_with_tempting_name']) AS family FROM f),
files AS (SELECT {_id("'T-FILE'", "a", "family")} AS case_id, study, 'T-FILE' AS task, family AS error_family, a AS base_artifact, family <> 'clean_role' AS corruption_present, CASE WHEN family = 'clean_role' THEN 'accept_provisionally' ELSE 'recover' END AS correct_action, role AS correct_label,
 CASE family WHEN 'role_misclassification' THEN '{{"primary_role":"' || role || '"}}' WHEN 'parser_failure_with_tempting_name' THEN '{{"parser_status":"parsed","primary_role":"' || role || '"}}' END AS correct_repair, 'curated_structural_provisional' AS oracle_status,
 CASE WHEN family = 'clean_role' THEN role ELSE {_case("role", V.WRONG_ROLE, f"'{V.OTHER_WRONG_ROLE}'")} END AS proposal, CASE WHEN family = 'parser_failure_with_tempting_name' THEN 'injected_parser_failure' ELSE 'parsed' END AS parser_status, 1 AS required_sets
 FROM fc WHERE family <> 'parser_failure_with_tempting_name' OR workbook)"""
_COLUMNS = f"""p AS (SELECT *, {_list(V.COLUMN_CONCEPTS)}[(p_partkey % {len(V.COLUMN_CONCEPTS)} + 1)::INT] AS concept, unnest(['clean_concept', 'concept_substitution']) AS family FROM part),
columns_ AS (SELECT {_id("'T-COL'", "p_brand", "p_size::VARCHAR", "p_partkey::VARCHAR", "family")} AS case_id, p_type AS study, 'T-COL' AS task, family AS error_family, p_brand AS base_artifact, family <> 'clean_concept' AS corruption_present, CASE WHEN family = 'clean_concept' THEN 'accept_provisionally' ELSE 'recover' END AS correct_action, concept AS correct_label,
 CASE WHEN family <> 'clean_concept' THEN '{{"concept":"' || concept || '"}}' END AS correct_repair, 'curated_semantic_provisional' AS oracle_status, CASE WHEN family = 'clean_concept' THEN concept ELSE {_case("concept", V.WRONG_CONCEPT, "NULL")} END AS proposal, (concept IN ({_list(V.SENSITIVE_CONCEPTS)[1:-1]})) AS sensitive
 FROM p WHERE concept IN ({_list(V.WRONG_CONCEPT)[1:-1]}))"""
_CODES = f"""o AS (SELECT *, unnest(['clean_encoding', 'code_direction_inversion', 'encoding_without_decisive_reference']) AS family FROM orders),
codes AS (SELECT {_id("'T-VAL'", "o_orderkey::VARCHAR", "'status'", "family")} AS case_id, 'orders' AS study, 'T-VAL' AS task, family AS error_family, o_orderkey::VARCHAR AS base_artifact, family <> 'clean_encoding' AS corruption_present,
 CASE family WHEN 'clean_encoding' THEN 'accept_provisionally' WHEN 'code_direction_inversion' THEN 'recover' ELSE 'abstain' END AS correct_action, 'value_encoding' AS correct_label,
 CASE WHEN family = 'code_direction_inversion' THEN '{{"mapping":{{"1":"' || o_orderstatus || '","2":"' || o_orderpriority || '"}}}}' END AS correct_repair, CASE WHEN family = 'encoding_without_decisive_reference' THEN 'procedural_missing_evidence' ELSE 'source_explicit' END AS oracle_status,
 CASE WHEN family = 'code_direction_inversion' THEN o_orderpriority ELSE o_orderstatus END AS first_code, CASE WHEN family = 'encoding_without_decisive_reference' THEN '' WHEN o_orderkey % 2 = 0 THEN 'get_dictionary_entry' ELSE 'compare_redundant_values' END AS verifier FROM o)"""
_CARDS = f"""k AS (SELECT *, {_list(V.OTHER_RELATIONSHIP)}[(c_custkey % {len(V.OTHER_RELATIONSHIP)} + 1)::INT] AS relation, unnest(['clean_identifier_linkage', 'identifier_identity_overclaim']) AS family FROM customer WHERE c_custkey % 5 <> 0),
cards AS (SELECT {_id("'T-ID'", "c_custkey::VARCHAR", "family")} AS case_id, c_mktsegment AS study, 'T-ID' AS task, family AS error_family, c_custkey::VARCHAR AS base_artifact, family <> 'clean_identifier_linkage' AS corruption_present, CASE WHEN family = 'clean_identifier_linkage' THEN 'accept_provisionally' ELSE 'recover' END AS correct_action,
 'identifier_linkage' AS correct_label, CASE WHEN family <> 'clean_identifier_linkage' THEN '{{"identity_proven":false,"relationship":"' || relation || '"}}' END AS correct_repair, 'aggregate_operational' AS oracle_status, relation AS proposed_relationship, family <> 'clean_identifier_linkage' AS proposed_identity_proven FROM k)"""
_PAIRS = f"""n AS (SELECT a.n_name AS l, b.n_name AS r, unnest(['clean_lineage_status', 'duplicate_lineage_independence_overclaim']) AS family FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name),
pairs AS (SELECT {_id("'T-ID'", "l", "r", "family")} AS case_id, 'T-ID' AS task, family AS error_family, l AS left_member, r AS right_member, family <> 'clean_lineage_status' AS corruption_present, CASE WHEN family = 'clean_lineage_status' THEN 'accept_provisionally' ELSE 'recover' END AS correct_action, 'source_independence' AS correct_label,
 CASE WHEN family <> 'clean_lineage_status' THEN '{{"independence_status":"nonindependent_same_lineage"}}' END AS correct_repair, 'recorded_provenance' AS oracle_status, CASE WHEN family = 'clean_lineage_status' THEN 'nonindependent_same_lineage' ELSE 'independent_distinct_lineage' END AS proposed_independence FROM n)"""
_POLICY = f"""s AS (SELECT *, {_list(_POLICIES)}[(s_suppkey % {len(_POLICIES)} + 1)::INT] AS concept FROM supplier),
policies AS (SELECT {_id("'T-GOV'", "s_suppkey::VARCHAR", "concept")} AS case_id, s_nationkey::VARCHAR AS study, 'T-GOV' AS task, concept AS error_family, s_suppkey::VARCHAR AS base_artifact, true AS corruption_present, 'escalate' AS correct_action, concept AS correct_label, NULL::VARCHAR AS correct_repair, 'procedural_human_owned' AS oracle_status,
 'Treat ' || s_name || ' as decided.' AS proposal, 'Only people may decide this.' AS evidence_basis FROM s)"""
_ORACLE = ["case_id", "task", "error_family", "corruption_present", "correct_action", "correct_label", "correct_repair", "oracle_status"]
_SHARED = [*_ORACLE[:1], "study", *_ORACLE[1:3], "base_artifact", *_ORACLE[3:]]


@query(f"WITH {_FILES} SELECT {', '.join(_SHARED)}, proposal, parser_status, required_sets FROM files")
def panel_file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.file_cases(files_of(spark, sf_dir)).select(*_SHARED, "proposal", "parser_status", F.size("required").alias("required_sets"))


@query(f"WITH {_COLUMNS} SELECT {', '.join(_SHARED)}, proposal, sensitive FROM columns_")
def panel_column_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.column_cases(columns_of(spark, sf_dir))
    return found.select(*_SHARED, "proposal", (F.size(F.get("required", F.lit(0))) > 0).alias("sensitive"))


@query(f"WITH {_CODES} SELECT {', '.join(_SHARED)}, first_code, verifier FROM codes")
def panel_encoding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = panel.encoding_cases(codes_of(spark, sf_dir))
    return found.select(*_SHARED, F.element_at("proposed_mapping", "1").alias("first_code"), F.array_join(F.get("required", F.lit(0)), ",").alias("verifier"))


@query(f"WITH {_CARDS} SELECT {', '.join(_SHARED)}, proposed_relationship, proposed_identity_proven FROM cards")
def panel_linkage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.linkage_cases(cards_of(spark, sf_dir)).select(*_SHARED, "proposed_relationship", "proposed_identity_proven")


@query(f"WITH {_PAIRS} SELECT {', '.join(_ORACLE)}, left_member, right_member, proposed_independence FROM pairs")
def panel_lineage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.lineage_cases(pairs_of(spark, sf_dir)).select(*_ORACLE, "left_member", "right_member", "proposed_independence")


@query(f"WITH {_POLICY} SELECT {', '.join(_SHARED)}, proposal, evidence_basis FROM policies")
def panel_governance_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.governance_cases(definitions_of(spark, sf_dir)).select(*_SHARED, "proposal", "evidence_basis")


def whole_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = (spark, sf_dir)
    return panel.build([
        panel.file_cases(files_of(*of)), panel.column_cases(columns_of(*of)), panel.encoding_cases(codes_of(*of)), panel.linkage_cases(cards_of(*of)),
        panel.lineage_cases(pairs_of(*of)), panel.governance_cases(definitions_of(*of)),
    ])


_ALL = f"{_FILES}, {_COLUMNS}, {_CODES}, {_CARDS}, {_PAIRS}, {_POLICY}"
_UNION = " UNION ALL ".join(f"SELECT {', '.join(_SHARED)} FROM {t}" for t in ("files", "columns_", "codes", "cards", "policies"))
_UNION += f" UNION ALL SELECT {', '.join('NULL' if c in ('study', 'base_artifact') else c for c in _SHARED)} FROM pairs"


@query(f"WITH {_ALL} {_UNION}")
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of cases in one panel whose ids are unique."""
    return whole_panel(spark, sf_dir).select(*_SHARED)


@query(f"WITH {_ALL}, u AS ({_UNION}) SELECT task, error_family, count(*) AS n, count(DISTINCT base_artifact) AS artifacts, count(*) FILTER (corruption_present) AS corrupted FROM u GROUP BY ALL")
def panel_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle's side of the split panel, counted."""
    public, oracle = panel.split_oracle(whole_panel(spark, sf_dir), ["corruption_present", "correct_action", "correct_label", "correct_repair", "required", "oracle_status"], ["case_id"])
    both = public.join(oracle, "case_id")
    return both.groupBy("task", "error_family").agg(F.count("*").alias("n"), F.count_distinct("base_artifact").alias("artifacts"), F.count_if("corruption_present").alias("corrupted"))


@query("SELECT p_brand AS artifact_id, p_size::VARCHAR AS sheet, p_type AS study, count(*) AS n, CASE WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS state FROM part GROUP BY ALL")
def card_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.card_index(columns_of(spark, sf_dir), ["artifact_id", "sheet", "study"])


def _file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("doc_"), d.cast("string"), F.lit(".csv"))
    structure = F.array(F.struct(F.lit(None).cast("string").alias("sheet_name"), F.col("n_chars").alias("rows"), F.lit(2).alias("columns"), F.array("lang", "source").alias("column_names")))
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("artifact_id"), name.alias("artifact_name"), F.concat("lang", F.lit("/Data_info/"), name).alias("path_context"), F.array("source").alias("component_hints"),
        evidence.compact_structure(structure).alias("structure"), F.col("source").alias("lineage_family"), F.lit("observed").alias("validity_status"),
    )


_BASE = """'"artifact_name":"doc_' || a || '.csv"'"""
_PATH = """'"path_context":"' || study || '/Data_info/doc_' || a || '.csv"'"""
_SHAPE = """CASE WHEN bad THEN '"withheld_until_reparse"' ELSE '{"column_names":["' || lang || '","' || source || '"],"columns":2,"rows":' || n_chars || '}' END"""
_CARD_SQL = f"""WITH {_FILES}, w AS (SELECT files.*, base_artifact AS a, parser_status = 'injected_parser_failure' AS bad, lang, source, n_chars, CASE WHEN parser_status = 'injected_parser_failure' THEN parser_status ELSE 'not_yet_requested' END AS shown FROM files JOIN documents ON doc_id::VARCHAR = base_artifact),
b AS (SELECT *, '{{' || {_BASE} || ',"parser_status":"' || shown || '",' || {_PATH} || '}}' AS context, '{{' || {_BASE} || ',"parser_status":"' || shown || '",' || {_PATH} || ',"structure":' || {_SHAPE} || '}}' AS shape FROM w),
v AS (SELECT *, CASE WHEN bad THEN context ELSE '{{' || {_BASE} || '}}' END AS names_only, CASE WHEN bad THEN shape ELSE '{{' || {_BASE} || ',"lineage_family":"' || source || '","parser_status":"' || shown || '",' || {_PATH} || ',"structure":' || {_SHAPE} || ',"validity_status":"observed"}}' END AS whole FROM b),
s AS (SELECT *, '{{"available_tools":["check_lineage","reparse_artifact"],"initial_observation":' || context AS head, ',"views":{{"names_only":' || names_only || ',"context":' || context || ',"structure":' || shape || ',"full":' || whole || '}}}}' AS tail FROM v)
SELECT case_id, head || tail AS hidden, head || ',"proposal_under_review":{{"primary_role":"' || proposal || '"}}' || tail AS visible FROM s"""


@query(_CARD_SQL)
def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four views of every file case as predictors see them, with and without the proposal."""
    cases = evidence.file_views(panel.file_cases(files_of(spark, sf_dir)), _file_facts(spark, sf_dir))
    tools = F.array(F.lit("reparse_artifact"), F.lit("check_lineage"))
    return cases.select("case_id", evidence.card(cases, tools).alias("hidden"), evidence.card(cases, tools, "visible").alias("visible"))
