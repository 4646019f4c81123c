"""Decisions about cases: normalisation, the evidence gate, fallbacks and the rule system.

A case is a row with case_id, task, obs (a struct of what is proposed), evidence (a struct of what the
tools would tell) and tools (array of the tools that exist). Repairs are canonical JSON, so that equal
repairs are equal texts. Everything is column expressions over one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V

OBS = (
    "artifact_name string, column_name string, parser_status string, proposed_role string, proposed_concept string, proposed_mapping map<string,string>, "
    "id_scope string, proposed_relationship string, proposed_identity_proven boolean, proposed_independence string, governance_scope string"
)
EVIDENCE = (
    "status string, column_names array<string>, sheet_names array<string>, mapping map<string,string>, order_agreement boolean, mismatch_n bigint, imaging_n bigint, "
    "relationship string, same_lineage boolean, independence string"
)
CASE = f"case_id string, study string, task string, error_family string, lineage_group string, obs struct<{', '.join(f.strip().replace(' ', ':', 1) for f in OBS.split(', '))}>, evidence struct<{', '.join(f.strip().replace(' ', ':', 1) for f in EVIDENCE.split(', '))}>, tools array<string>"


def canonical(*pairs: tuple[str, Column]) -> Column:
    """JSON object of the pairs in the order of their names, null values left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(pairs)]))


def canonical_map(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def mapping_repair(m: Column) -> Column:
    return F.concat(F.lit('{"mapping":'), canonical_map(m), F.lit("}"))


def same_map(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def scope() -> Column:
    return F.coalesce(F.col("obs.id_scope"), F.lit(V.DEFAULT_SCOPE))


def allowed_labels() -> Column:
    words = lambda w: F.array(*map(F.lit, w))
    return (
        F.when(F.col("task") == "T-FILE", words(V.FILE_ROLES))
        .when(F.col("task") == "T-COL", words(V.COLUMN_CONCEPTS))
        .when(F.col("task") == "T-VAL", words(["value_encoding"]))
        .when(F.col("task") == "T-ID", F.array(scope()))
        .otherwise(F.array(F.coalesce(F.col("obs.governance_scope"), F.lit("governance"))))
    )


def forced_label(label: Column) -> Column:
    """Three tasks leave the label no choice."""
    return (
        F.when(F.col("task") == "T-VAL", "value_encoding").when(F.col("task") == "T-ID", scope()).when(F.col("task") == "T-GOV", F.col("obs.governance_scope")).otherwise(label)
    )


def normalized(cases: DataFrame, called: str = "called") -> DataFrame:
    """Adds action, label, repair of a raw decision (raw_action, raw_label, raw_repair) after `called` tools."""
    action = F.when(F.col("raw_action").isin(*V.ACTIONS), F.col("raw_action")).otherwise("abstain")
    label = forced_label(F.col("raw_label"))
    has = lambda tool: F.array_contains(called, tool)
    reparsed = (F.col("obs.parser_status") == "injected_parser_failure") & has("reparse_artifact")
    file_repair = F.when(F.coalesce(reparsed, F.lit(False)), canonical(("parser_status", F.lit("parsed")), ("primary_role", label))).otherwise(canonical(("primary_role", label)))
    id_repair = (
        F.when(scope() == V.DEFAULT_SCOPE, canonical(("operation", F.lit("restore_analysis_id_order"))))
        .when((scope() == "identifier_linkage") & has("check_id_overlap"), canonical(("identity_proven", F.lit(False)), ("relationship", F.col("evidence.relationship"))))
        .when((scope() == "source_independence") & has("check_lineage"), canonical(("independence_status", F.col("evidence.independence"))))
        .otherwise(F.col("raw_repair"))
    )
    repair = (
        F.when(action != "recover", F.lit(None).cast("string"))
        .when(F.col("task") == "T-FILE", file_repair)
        .when(F.col("task") == "T-COL", canonical(("concept", label)))
        .when(F.col("task") == "T-ID", id_repair)
        .otherwise(F.col("raw_repair"))
    )
    return cases.withColumns({"action": action, "label": label, "repair": repair})


def violation(action: Column, label: Column, called: Column) -> Column:
    """Why the gate refuses a decision; null if it doesn't. The first reason counts."""
    task, commit = F.col("task"), action.isin(*V.COMMITS)
    has = lambda *tools: F.arrays_overlap(called, F.array(*map(F.lit, tools)))
    need = S.first_match([(scope() == s, t) for s, t in V.SCOPE_TOOLS.items()], "unknown")
    return (
        F.when((task == "T-GOV") & (action != "escalate"), "governance must be escalated")
        .when((task == "T-GOV") & ~has("escalate_to_human"), "escalation without escalate_to_human")
        .when(~commit, F.lit(None).cast("string"))
        .when((task == "T-FILE") & ~has("reparse_artifact"), "file role without reparse_artifact")
        .when((task == "T-COL") & label.isin(*V.SENSITIVE_CONCEPTS) & ~has("profile_values"), "sensitive concept without profile_values")
        .when((task == "T-VAL") & ~has(*V.VERIFIERS), "value encoding without a verifier")
        .when((task == "T-ID") & ~F.array_contains(called, need), F.concat(scope(), F.lit(" without "), need))
    )


def fallback(cases: DataFrame, reason: str) -> DataFrame:
    """What stands where nothing was decided: governance is escalated, all else abstained from."""
    governance = F.col("task") == "T-GOV"
    fixed = F.col("task").isin("T-VAL", "T-ID", "T-GOV")
    return cases.withColumns(
        {
            "action": F.when(governance, "escalate").otherwise("abstain"),
            "label": F.when(fixed, forced_label(F.lit(None).cast("string"))),
            "repair": F.lit(None).cast("string"),
            "unresolved": F.array(F.lit(reason)),
        }
    )


def gated(cases: DataFrame, called: str = "called") -> DataFrame:
    """Normalised decisions; those the gate refuses become fallbacks. Adds violation and authorized."""
    found = normalized(cases, called)
    found = found.withColumn("violation", violation(F.col("action"), F.col("label"), F.col(called)))
    refused = F.col("violation").isNotNull()
    return found.withColumns(
        {
            "authorized": ~refused,
            "action": F.when(refused, F.when(F.col("task") == "T-GOV", "escalate").otherwise("abstain")).otherwise(F.col("action")),
            "repair": F.when(~refused, F.col("repair")),
            "label": F.when(~refused | F.col("task").isin("T-VAL", "T-ID", "T-GOV"), F.col("label")),
        }
    )


def verifier() -> Column:
    """The first verifying tool that the case has."""
    return F.get(F.filter(F.array(*map(F.lit, V.VERIFIERS)), lambda v: F.array_contains("tools", v)), F.lit(0))


def rule_system(cases: DataFrame) -> DataFrame:
    """Decisions of the rules alone: action, label, repair and called tools of each case."""
    task, e, o = F.col("task"), F.col("evidence"), F.col("obs")
    role = S.infer_file_role(F.coalesce(o["artifact_name"], F.lit("")), e["column_names"], e["sheet_names"])
    concept = S.infer_column_concept(F.coalesce(o["column_name"], F.lit("")))
    label = F.when(task == "T-FILE", role).when(task == "T-COL", concept).otherwise(forced_label(F.lit(None).cast("string")))
    cases = cases.withColumns({"__label": label, "__verifier": verifier()})
    label, check = F.col("__label"), F.col("__verifier")
    right = (
        F.when(task.isin("T-FILE", "T-COL"), label.eqNullSafe(F.when(task == "T-FILE", o["proposed_role"]).otherwise(o["proposed_concept"])))
        .when(task == "T-VAL", same_map(o["proposed_mapping"], e["mapping"]))
        .when(scope() == V.DEFAULT_SCOPE, F.coalesce(e["order_agreement"], F.lit(False)))
        .when(scope() == "identifier_linkage", o["proposed_relationship"].eqNullSafe(e["relationship"]) & o["proposed_identity_proven"].eqNullSafe(F.lit(False)))
        .otherwise(o["proposed_independence"].eqNullSafe(e["independence"]))
    )
    stuck = ((task == "T-FILE") & ~e["status"].eqNullSafe(F.lit("parsed"))) | ((task == "T-VAL") & check.isNull())
    action = F.when(task == "T-GOV", "escalate").when(stuck, "abstain").when(right, "accept_provisionally").otherwise("recover")
    broken = o["parser_status"].eqNullSafe(F.lit("injected_parser_failure"))
    fix = (
        F.when((task == "T-FILE") & broken, canonical(("parser_status", F.lit("parsed")), ("primary_role", label)))
        .when(task == "T-FILE", canonical(("primary_role", label)))
        .when(task == "T-COL", canonical(("concept", label)))
        .when(task == "T-VAL", mapping_repair(e["mapping"]))
        .when(scope() == V.DEFAULT_SCOPE, canonical(("operation", F.lit("restore_analysis_id_order"))))
        .when(scope() == "identifier_linkage", canonical(("identity_proven", F.lit(False)), ("relationship", e["relationship"])))
        .otherwise(canonical(("independence_status", e["independence"])))
    )
    profiled = label.isin(*V.SENSITIVE_CONCEPTS) | ((label == "unknown_or_study_specific") & F.array_contains("tools", "profile_values"))
    need = S.first_match([(scope() == s, t) for s, t in V.SCOPE_TOOLS.items()], "check_lineage")
    called = (
        F.when(task == "T-FILE", F.array(F.lit("reparse_artifact")))
        .when((task == "T-COL") & profiled, F.array(F.lit("profile_values")))
        .when(task == "T-COL", F.array().cast("array<string>"))
        .when(task == "T-VAL", F.array(F.coalesce(check, F.lit("profile_values"))))
        .when(task == "T-ID", F.array(need))
        .otherwise(F.array(F.lit("escalate_to_human")))
    )
    decided = cases.withColumns({"label": label, "called": called, "__action": action, "__fix": fix})
    decided = decided.withColumns({"action": F.col("__action"), "repair": F.when(F.col("__action") == "recover", F.col("__fix"))})
    return decided.drop("__label", "__verifier", "__action", "__fix")
