"""Redacted views against a plain recursion, and the shapes of cards."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import vocabulary as V
from attestra.operators import agent, evidence, panel

KEYS = [*V.PROVISIONAL_KEYS, "a", "b", 'q"uote', "back\\slash", "é", "x:y", "{", "[,]"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {k: value(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(4))}
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(-5, 99), rng.choice(["", "text, with: {all} [of] it", 'say "proposed_concept":', "tab\t\\", "component_hints"]), 2.5][kind]


def without(v):
    if isinstance(v, dict):
        return {k: without(x) for k, x in v.items() if k not in V.PROVISIONAL_KEYS}
    return [without(x) for x in v] if isinstance(v, list) else v


def test_deletion_at_any_depth(spark):
    rng = random.Random(7)
    documents = [value(rng) for _ in range(400)] + [{"component_hints": {"component_hints": [1, {"a": 2}]}}, {}, [], {"a": {"proposed_concept": {}}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(-1, "{broken"), (-2, None), (-3, "")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, t string").select("i", evidence.without_keys(F.col("t")).alias("t")).collect()}
    assert got[-1] is None and got[-2] is None and got[-3] is None
    for i, d in enumerate(documents):
        assert json.loads(got[i]) == without(d), (d, got[i])


def test_structures_are_compact(spark):
    kind = "array<struct<sheet_name: string, rows: bigint, columns: int, column_names: array<string>>>"
    names = [f"c{i}" for i in range(100)]
    rows = [("t", [(None, 5, 100, names)]), ("w", [("One", 5, 100, names), ("Two", 0, 1, ["x"])])]
    got = {r["k"]: json.loads(r["s"]) for r in spark.createDataFrame(rows, f"k string, s {kind}").select("k", evidence.compact_structure(F.col("s")).alias("s")).collect()}
    assert got["t"] == {"rows": 5, "columns": 100, "column_names": names[:80]}
    assert got["w"] == {"sheets": [{"sheet_name": "One", "rows": 5, "columns": 100, "column_names": names[:40]}, {"sheet_name": "Two", "rows": 0, "columns": 1, "column_names": ["x"]}]}


def test_cards_of_columns(spark):
    columns = spark.createDataFrame([("a", "s", "1", "age", "current_age")], "artifact_id string, study string, sheet string, column_name string, concept string")
    cases = panel.column_cases(columns)
    facts = cases.select("case_id").crossJoin(F.broadcast(spark.createDataFrame([("f.csv", "age", "1", "demographics", ["mixed"], '{"n":3}')], "artifact_name string, column_name string, sheet_name string, parent_primary_role string, component_roles array<string>, signature string")))
    viewed = evidence.column_views(cases, facts)
    shown = viewed.select("error_family", "evidence_views", evidence.card(viewed, F.array(F.lit("profile_values")), "contract").alias("card")).collect()
    assert len(shown) == 2
    for r in shown:
        wrong = r["error_family"] == "concept_substitution"
        told = json.loads(r["card"])
        proposal = "age_at_onset" if wrong else "current_age"
        assert told["proposal_under_review"] == {"concept": proposal} and json.loads(r["evidence_views"]["full"])["proposed_concept"] == proposal
        assert list(told["views"]) == ["names_only", "context", "full"] and told["views"]["full"]["value_signature"] == {"n": 3}
        assert "proposed_concept" not in json.dumps(told["views"]) and told["views"]["context"]["parent_component_roles"] == ["mixed"]
    with pytest.raises(ValueError, match="unknown interface"):
        evidence.card(viewed, F.array(F.lit("x")), "other")


def test_instructions_name_the_labels(spark):
    row = spark.createDataFrame([("T-VAL",)], "task string").withColumn("obs", F.struct(F.lit(None).cast("string").alias("id_scope"), F.lit(None).cast("string").alias("governance_scope")))
    hidden, contract = (row.select(agent.instructions(i)).first()[0] for i in ("hidden", "contract"))
    assert hidden.endswith("Labels: value_encoding.") and "proposal_matches_my_label" in contract and "under review" not in hidden
