"""Changed-evidence consistency: the decisive evidence of a case is flipped, and the decision must follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from .gate import canonical, mapping_repair, rule_system, same_map, scope, verifier


def family() -> Column:
    """Of the cases whose evidence can be flipped; null for all others."""
    ident = F.col("task") == "T-ID"
    return (
        F.when(ident & F.col("obs.id_scope").isNull(), "T-ID:imaging_order")
        .when(ident & (scope() == "identifier_linkage"), "T-ID:linkage")
        .when(ident & (scope() == "source_independence"), "T-ID:lineage")
        .when((F.col("task") == "T-VAL") & verifier().isNotNull(), "T-VAL:encoding")
        .when((F.col("task") == "T-FILE") & (F.col("obs.parser_status") == "injected_parser_failure"), "T-FILE:parser")
    )


def rotated(m: Column) -> Column:
    """Every key takes the next key's value, the last the first's."""
    values = F.map_values(m)
    return F.map_from_arrays(F.map_keys(m), F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1)))


def mutated(cases: DataFrame) -> DataFrame:
    """The cases of some family with their evidence flipped, and what is right then (gold_action, gold_repair)."""
    rows = cases.withColumn("family", family()).filter("family IS NOT NULL")
    e, o, f = F.col("evidence"), F.col("obs"), F.col("family")
    order, link, line, code, parse = (f == x for x in ("T-ID:imaging_order", "T-ID:linkage", "T-ID:lineage", "T-VAL:encoding", "T-FILE:parser"))
    agree = ~F.coalesce(e["order_agreement"], F.lit(False))
    relation = S.first_match([(e["relationship"] == k, v) for k, v in V.OTHER_RELATIONSHIP.items()], "partial_overlap")
    together = ~F.coalesce(e["same_lineage"], F.lit(True))
    status = F.when(together, "nonindependent_same_lineage").otherwise("independent_distinct_lineage")
    changed = (
        e.withField("order_agreement", F.when(order, agree).otherwise(e["order_agreement"]))
        .withField("mismatch_n", F.when(order, F.when(agree, F.lit(0)).otherwise(F.lit(8))).otherwise(e["mismatch_n"]).cast("bigint"))
        .withField("relationship", F.when(link, relation).otherwise(e["relationship"]))
        .withField("same_lineage", F.when(line, together).otherwise(e["same_lineage"]))
        .withField("independence", F.when(line, status).otherwise(e["independence"]))
        .withField("mapping", F.when(code, rotated(e["mapping"])).otherwise(e["mapping"]))
        .withField("status", F.when(parse, F.lit("parser_failure")).otherwise(e["status"]))
        .withField("column_names", F.when(~parse, e["column_names"]))
        .withField("sheet_names", F.when(~parse, e["sheet_names"]))
    )
    rows = rows.withColumn("evidence", changed)
    right = (
        F.when(order, e["order_agreement"])
        .when(link, o["proposed_relationship"].eqNullSafe(e["relationship"]) & o["proposed_identity_proven"].eqNullSafe(F.lit(False)))
        .when(line, o["proposed_independence"].eqNullSafe(e["independence"]))
        .when(code, same_map(o["proposed_mapping"], e["mapping"]))
    )
    fix = (
        F.when(order, canonical(("operation", F.lit("restore_analysis_id_order"))))
        .when(link, canonical(("identity_proven", F.lit(False)), ("relationship", e["relationship"])))
        .when(line, canonical(("independence_status", e["independence"])))
        .when(code, mapping_repair(e["mapping"]))
    )
    rows = rows.withColumns({"__right": right, "__fix": fix})
    action = F.when(parse, "abstain").when(F.col("__right"), "accept_provisionally").otherwise("recover")
    rows = rows.withColumns({"gold_action": action, "gold_repair": F.when(~parse & ~F.col("__right"), F.col("__fix"))})
    strength = F.when(line, "mechanistic (OOD value)").when(parse, "policy-derived").otherwise("mechanistic")
    return rows.withColumn("strength", strength).drop("__right", "__fix")


def cells(cases: DataFrame, oracle: DataFrame) -> DataFrame:
    """(system, family, n, four cells, cec, two sides) for the rule system and for one that repeats the old answer.

    oracle: case_id, gold_action, gold_repair. Families are summed over in the rows 'all' and
    'mechanistic'.
    """
    # each case carries the answer of the rules through its change: they run before and after it on the row itself
    known = cases.columns
    before = rule_system(cases)
    before = before.select(*known, F.struct(F.col("action").alias("a0"), F.col("repair").alias("r0")).alias("__before"))
    changed = mutated(before)
    changed = changed.select(*known, "__before", "family", "strength", F.struct(F.col("gold_action").alias("new_action"), F.col("gold_repair").alias("new_repair")).alias("__gold"))
    after = rule_system(changed).select("case_id", "family", "strength", "__before.*", "__gold.*", F.col("action").alias("a1"), F.col("repair").alias("r1"))
    joined = after.join(oracle.select("case_id", "gold_action", "gold_repair"), "case_id")
    ok = lambda a, r, ga, gr: F.col(a).eqNullSafe(F.col(ga)) & F.col(r).eqNullSafe(F.col(gr))
    systems = F.explode(
        F.array(
            F.struct(F.lit("deterministic_reference").alias("system"), ok("a0", "r0", "gold_action", "gold_repair").alias("o"), ok("a1", "r1", "new_action", "new_repair").alias("m")),
            F.struct(F.lit("frozen_answer").alias("system"), F.lit(True).alias("o"), ok("gold_action", "gold_repair", "new_action", "new_repair").alias("m")),
        )
    ).alias("s")
    groups = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("strength").startswith("mechanistic"), F.lit("mechanistic")), F.col("family")))).alias("family")
    rows = joined.select(groups, systems).select("family", "s.*")
    n = F.count("*")
    both, first, second = F.count_if(F.col("o") & F.col("m")), F.count_if(F.col("o") & ~F.col("m")), F.count_if(~F.col("o") & F.col("m"))
    return rows.groupBy("system", "family").agg(
        n.alias("n"), both.alias("correct_correct"), first.alias("correct_wrong"), second.alias("wrong_correct"), F.count_if(~F.col("o") & ~F.col("m")).alias("wrong_wrong"),
        (both / n).alias("cec"), ((both + first) / n).alias("original_side"), ((both + second) / n).alias("mutated_side"),
    )
