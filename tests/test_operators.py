import pytest
from pyspark.sql import functions as F

from attestra.operators import agent, bundle, cec, effects, gate, linkage, panel, profile, score, statistics
from attestra.operators.positions import positions
from attestra.plans import audit, cohorts


def test_profiles_never_show_identifier_values(spark):
    df = spark.createDataFrame([("AB-001", "x", 1.5), ("CD-002", "y", float("nan")), (None, "x", None)], "SubjectID string, grp string, v double")
    rows = {r["column_name"]: r for r in profile.signature(df, ["SubjectID", "grp", "v"]).collect()}
    assert rows["SubjectID"]["unique_n"] == 2 and rows["SubjectID"]["missing_n"] == 1 and rows["v"]["missing_n"] == 2
    shown = str(list(rows.values())) + str(profile.identifier_shape(df, "SubjectID").collect()) + str(profile.categories(df, df.columns).collect())
    assert "AB-001" not in shown and "AA-###" in shown
    assert {(r["category"], r["n"]) for r in profile.categories(df, ["grp", "SubjectID"]).collect()} == {("x", 2), ("y", 1)}


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert [r["missing_fraction"] for r in profile.counts(df, ["a", "b"]).collect()] == [0.0, 0.0]
    assert profile.numeric(df, ["b"]).first()["numeric_fraction"] == 0.0


def test_guarded_lookup_takes_no_value_of_a_repeated_key(spark):
    left = spark.createDataFrame([("001",), ("2",), ("3",), (None,)], "id string")
    right = spark.createDataFrame([("1", 10), ("2", 20), ("02", 21)], "k string, v int")
    got = {r["id"]: (r["source_status"], r["source_v"]) for r in linkage.guarded_lookup(left, "id", right, "k", ["v"]).collect()}
    assert got == {"001": ("matched_unique", 10), "2": ("duplicate_key", None), "3": ("not_in_source", None), None: ("not_in_source", None)}


def test_covers_order_and_shards(spark):
    oracle = spark.createDataFrame([("a", 2), ("b", 1)], "case_id string, oracle_pos int")
    assert [r["case_id"] for r in linkage.merge_shards(spark.createDataFrame([("a",), ("b",)], "case_id string"), oracle).collect()] == ["b", "a"]
    for wrong in ([("a",)], [("a",), ("b",), ("c",)], [("a",), ("a",), ("b",)]):
        with pytest.raises(ValueError, match="case_id"):
            linkage.merge_shards(spark.createDataFrame(wrong, "case_id string"), oracle)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, id string")
    assert linkage.order_agreement(a, a, "pos", "id").first()["order_agreement"]
    with pytest.raises(ValueError, match="order"):
        linkage.assert_same_order(a, a.withColumn("id", F.lit("x")), "pos", "id")


def test_positions_are_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 10007 - 5000).alias("v"), (F.col("id") % 3).alias("g"))
    got = positions(df, "v", "p", ["g"], 64).toPandas()
    assert (got.sort_values(["g", "v"]).groupby("g").cumcount() + 1 == got.sort_values(["g", "v"]).p).all()


def test_corruption_keeps_the_keys(spark):
    keys = spark.range(101).select(F.col("id").alias("pos"), F.col("id").alias("key"))
    for r in panel.corruption_grid(keys, [(0.0, 1), (0.05, 1), (0.5, 3)]).collect():
        assert r["overlap_n"] == 101 and r["moved"] == (r["chosen"] if r["chosen"] > 1 else 0) and r["chosen"] == round(r["rate"] * 101)


def test_synthetic_panel(spark):
    cases = panel.synthetic_cases(spark)
    assert {r["value"]: r["n"] for r in panel.counts(cases, ["task"]).collect()} == {"T-FILE": 24, "T-COL": 48, "T-VAL": 6, "T-ID": 6, "T-GOV": 6}
    assert cases.select("case_id").distinct().count() == 90
    same = (F.col("corruption_present")) & (F.col("proposal") == F.col("correct_label"))
    assert cases.filter(same).count() == 0 and panel.synthetic_cases(spark, strict_reference=True).filter(same).count() > 0
    assert {k: v.count() for k, v in panel.synthetic_tables(spark).items()}["site_a_dictionary"] == 4


def case(spark, task, obs=None, evidence=None, tools=(), **more):
    def struct(spec, given):
        fields = [f.strip().split(" ", 1) for f in spec.split(", ")]
        return F.struct(*[(F.lit((given or {}).get(n)) if not isinstance((given or {}).get(n), dict) else F.create_map(*[F.lit(x) for kv in given[n].items() for x in kv])).cast(t).alias(n) for n, t in fields])

    row = spark.range(1).select(F.lit("c").alias("case_id"), F.lit(task).alias("task"), struct(gate.OBS, obs).alias("obs"), struct(gate.EVIDENCE, evidence).alias("evidence"), F.array(*map(F.lit, tools)).cast("array<string>").alias("tools"))
    return row.select("*", *[(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v).cast("string")).alias(k) for k, v in more.items()])


@pytest.mark.parametrize(
    ("task", "obs", "action", "label", "called", "refused"),
    [
        ("T-ID", {}, "recover", None, [], True), ("T-ID", {}, "recover", None, ["check_imaging_order"], False), ("T-ID", {}, "abstain", None, [], False),
        ("T-GOV", {"governance_scope": "g"}, "recover", None, [], True), ("T-GOV", {"governance_scope": "g"}, "escalate", None, ["escalate_to_human"], False),
        ("T-VAL", {}, "accept_provisionally", None, ["profile_values"], True), ("T-VAL", {}, "accept_provisionally", None, ["compare_redundant_values"], False),
        ("T-COL", {}, "accept_provisionally", "diagnosis", [], True), ("T-COL", {}, "accept_provisionally", "panss_item", [], False), ("T-FILE", {}, "recover", "mixed", [], True),
    ],
)
def test_gate(spark, task, obs, action, label, called, refused):
    got = gate.gated(case(spark, task, obs, raw_action=action, raw_label=label, raw_repair=None, called=called)).first()
    assert (got["violation"] is not None) == refused
    if not refused and task == "T-ID" and action == "recover":
        assert got["repair"] == '{"operation":"restore_analysis_id_order"}'
    if refused:
        assert got["action"] == ("escalate" if task == "T-GOV" else "abstain")


def test_scores_of_missing_labels_and_unsupported_commits(spark):
    rows = spark.createDataFrame(
        [
            ("a", "T-COL", True, "recover", "x", '{"concept":"x"}', [["profile_values"]], "abstain", None, None, [], None, []),
            ("b", "T-COL", False, "accept_provisionally", "x", None, [["profile_values"]], "accept_provisionally", "x", None, [], None, []),
            ("c", "T-COL", False, "accept_provisionally", "x", None, [[]], "accept_provisionally", "x", None, ["t"], None, ["rejected"]),
        ],
        "case_id string, task string, gold_corruption boolean, gold_action string, gold_label string, gold_repair string, required array<array<string>>, action string, label string, repair string, called array<string>, observed array<string>, history array<string>",
    )
    got = {r["case_id"]: r for r in score.scored(rows).collect()}
    assert got["a"]["pred_label_missing"] and not got["a"]["committed"] and got["a"]["relevant_tool_precision"] is None
    assert got["b"]["unsafe_commit"] and not got["b"]["case_success"]
    assert got["c"]["case_success"] and got["c"]["nonminimal_calls"] == 1 and got["c"]["gate_rejections"] == 1


def test_mcnemar_and_interval_give_the_published_values(spark):
    pairs = spark.range(230).select((F.col("id") < 20).cast("int").alias("a"), F.col("id").between(20, 136).cast("int").alias("b"))
    got = statistics.mcnemar(pairs).first()
    assert (got["left_only"], got["right_only"]) == (20, 117) and got["p"] == pytest.approx(7.157152153718532e-18, rel=1e-9)
    row = statistics.interval(spark.createDataFrame([(0.4217, 0.04304, 16), (0.5, 0.1, 1)], "estimate double, se double, clusters bigint")).collect()
    assert (row[0]["df"], round(row[0]["ci_low"], 3), round(row[0]["ci_high"], 3)) == (15, 0.33, 0.513) and row[1]["ci_low"] is None


def test_arms_are_paired_one_to_one(spark):
    arm = lambda *rows: spark.createDataFrame(rows, "case_id string, g int, m int")
    a, b = arm(("x", 1, 0), ("y", 2, 1)), arm(("y", 2, 0), ("x", 1, 1), ("z", 3, 1))
    assert {(r["case_id"], r["d"]) for r in statistics.contrast(a, b, "m", ["g"]).collect()} == {("x", 1.0), ("y", -1.0)}
    for left, right in ((a.union(a), b), (a, b.union(b))):
        with pytest.raises(Exception, match="case_id repeats"):
            statistics.contrast(left, right, "m", ["g"]).collect()


def test_quantiles_of_student(spark):
    """Against a table of t values."""
    table = {1: (6.3137515, 12.7062047, 63.6567412), 2: (2.9199856, 4.3026527, 9.9248432), 5: (2.0150484, 2.5705818, 4.0321430), 15: (1.7530504, 2.1314495, 2.9467129), 30: (1.6972609, 2.0422725, 2.7499957),
             120: (1.6576509, 1.9799304, 2.6174211), 1_000_000: (1.6448551, 1.9599668, 2.5758345)}
    df = spark.createDataFrame([(k,) for k in table], "k int")
    got = {r["k"]: tuple(r)[1:] for r in df.select("k", *[statistics.t_quantile(p, F.col("k")) for p in (0.95, 0.975, 0.995)]).collect()}
    for k, want in table.items():
        assert got[k] == pytest.approx(want, abs=5e-7 * max(want))


def test_cluster_error_is_the_closed_form(spark):
    d = [1, 0, 1, 1, 0, 0, -1, 1]
    df = spark.createDataFrame([(i // 2, float(x)) for i, x in enumerate(d)], "g int, d double")
    mean = sum(d) / 8
    sums = [sum(d[2 * g : 2 * g + 2]) - 2 * mean for g in range(4)]
    assert statistics.cluster_se(df, "g").first()["se"] == pytest.approx((4 / 3 * sum(s * s for s in sums) / 64) ** 0.5)


def test_rules_follow_changed_evidence_and_frozen_answers_do_not(spark, sf):
    cases = audit.typed_cases(spark, sf)
    oracle = gate.rule_system(cases).select("case_id", F.col("action").alias("gold_action"), F.col("repair").alias("gold_repair"))
    got = {(r["system"], r["family"]): r["cec"] for r in cec.cells(cases, oracle).collect()}
    assert got["deterministic_reference", "all"] == 1.0 and got["frozen_answer", "T-ID:imaging_order"] == 0.0


def test_effects(spark, sf):
    c = cohorts.cohort(spark, sf)
    effect = {r["feature"]: r["effect"] for r in effects.smd(c).collect()}
    flipped = {r["feature"]: r["effect"] for r in effects.smd(c.withColumn("diagnosis", effects.inverted("diagnosis"))).collect()}
    assert all(abs(effect[k] + flipped[k]) < 1e-9 for k in effect)
    a = {r["feature"]: r["coefficient"] for r in effects.adjusted_coefficient(c).collect()}
    b = {r["feature"]: r["coefficient"] for r in effects.adjusted_coefficient(c.withColumn("sex", effects.inverted("sex"))).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert effects.valid(c).first()["bad_vectors"] == 0
    assert effects.auc(spark.createDataFrame([(1, 2.0), (0, 1.0), (1, 1.0), (0, 0.0)], "y int, x double")).first()["auc"] == pytest.approx(0.875)


def test_cross_validated_auc_is_a_probability(spark):
    rows = spark.range(80).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("diagnosis"), F.array((F.col("id") % 2 + F.col("id") % 5).cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    assert 0.5 < effects.auc(effects.cross_validated(rows, F.lit(1))).first()["auc"] <= 1.0


def test_bundle_conserves_subjects(spark, sf):
    s = bundle.study_summary(cohorts.bundle_of(spark, sf)).first()
    assert s["matched"] + s["missing"] + s["duplicate"] == s["subjects"]
    assert "pepper" not in str(cohorts.bundle_of(spark, sf).limit(5).collect())


def test_a_bridge_in_another_order_is_an_error(spark):
    subjects = spark.createDataFrame([(1, "a", 30, "1", "2", 1, [1.0]), (2, "b", 31, "1", "1", 1, [float("nan")])], "pos int, analysis_id string, age int, sex string, diagnosis string, site int, features array<double>")
    source = spark.createDataFrame([("A", 30, "1", "2"), ("c", 1, "1", "1")], "id string, a int, s string, d string")
    names = {"key": "id", "age": "a", "sex": "s", "diagnosis": "d"}
    whole = lambda bridge: bundle.whole(subjects, source, spark.createDataFrame(bridge, "pos int, analysis_id string"), names, "X", "t", "salt", {})
    got = {r["subject_key"]: r for r in whole([(1, "a"), (2, "b")]).collect()}
    assert sorted((r["clinical_source_join_status"], r["sfnc_available"], r["source_age"]) for r in got.values()) == [("matched_verified", "yes", "30"), ("not_in_source_table", "no", "")]
    for wrong in ([(1, "b"), (2, "a")], [(1, "a")], [(1, "a"), (2, "b"), (3, "c")]):
        with pytest.raises(Exception, match="differ in order"):
            whole(wrong).collect()


def test_cohorts_are_checked_as_they_are_read(spark):
    cells = [(p, i, j, float(10 * i + j)) for p in (0, 1) for i in range(3) for j in range(3)]
    fields = ["Site", "age", "diagnosis(1:SZ)", "gender(1:male; 2:female)"]
    scores = [(0, fields, [4.0, 30.0, 1.0, 2.0]), (1, fields[1:], [31.0, 2.0, 1.0])]

    def load(cells=cells, scores=scores):
        return effects.load_cohort(spark.createDataFrame(cells, "pos int, i int, j int, value double"), spark.createDataFrame(scores, "pos int, fields array<string>, values array<double>")).orderBy("pos").collect()

    assert [tuple(r) for r in load()] == [(0, [10.0, 20.0, 21.0], 1, 30.0, 2, 4.0), (1, [10.0, 20.0, 21.0], 2, 31.0, 1, 1.0)]
    for wrong, message in (
        ({"cells": cells[:-1]}, "not square"), ({"cells": cells[:9]}, "rows differ"), ({"scores": scores[:1]}, "rows differ"), ({"scores": [scores[0], (1, fields[1:], [31.0, 3.0, 1.0])]}, "diagnosis"),
        ({"cells": [*cells[:-2], (1, 2, 1, float("nan")), cells[-1]]}, "non-finite"), ({"scores": [scores[0], (1, ["age", "diagnosis(1)"], [31.0, 2.0])]}, "sex"),
    ):
        with pytest.raises(Exception, match=message):
            load(**wrong)


def test_loop_rejects_then_takes_a_tool_then_accepts(spark):
    offer = '{"action":"accept_provisionally","label":"diagnosis"}'
    c = case(spark, "T-COL", {"proposed_concept": "diagnosis"}, tools=("profile_values",), script=["```json\n" + offer + "\n```", '{"type":"tool","tool_name":"profile_values"}', offer])
    got = agent.play(c, agent.scripted(), 4).first()
    assert (got["action"], got["label"], got["history"]) == ("accept_provisionally", "diagnosis", ["rejected", "ok"])
    gone = case(spark, "T-COL", {}, script=['{"tool":"profile_values"}', offer, "prose", offer, offer, offer])
    got = agent.play(gone, agent.scripted(), 4).first()
    assert got["action"] == "abstain" and got["history"][0] == "unavailable" and not got["parse_success"]


def test_text_parsing():
    assert agent.first_object_text('so {bad} then {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert agent.first_object_text("none") is None


def test_adjusted_coefficients_and_controls_by_brute_force(spark, sf):
    import numpy as np

    c = cohorts.cohort(spark, sf).withColumn("site", (F.col("pos") % 3).cast("int"))
    rows = c.orderBy("pos").collect()
    x = np.array([r["features"] for r in rows])
    std = lambda v: (v - v.mean()) / v.std()
    design = np.stack([np.ones(len(rows)), [float(r["diagnosis"] == 1) for r in rows], std(np.array([r["age"] for r in rows])), std(np.array([float(r["sex"]) for r in rows])),
                       *[[float(r["site"] == k) for r in rows] for k in (1, 2)]], 1)
    want = (np.linalg.pinv(design) @ x)[1]
    got = {r["feature"]: r["coefficient"] for r in effects.adjusted_coefficient(c).collect()}
    assert np.allclose([got[k] for k in range(len(want))], want, atol=1e-8)
    found = {(r["family"], r["rate"]): r for r in effects.sensitivity(c, [(0.0, 3), (0.5, 3)]).collect()}
    assert len(found) == 6 and found["row_order", 0.0]["rmse"] == pytest.approx(0) and found["diagnosis_inversion", 0.5]["adjusted_rmse"] > 0
    sex, turned = found["global_sex_recode_control", 1.0], found["global_diagnosis_inversion_control", 1.0]
    assert sex["adjusted_rmse"] == pytest.approx(0, abs=1e-9) and turned["correlation"] == pytest.approx(-1) and turned["adjusted_correlation"] == pytest.approx(-1)


def test_downstream_report_reads_the_summary(spark):
    rows = [("row_order", 0.0, 0.75, 0.0), ("row_order", 0.5, 0.6, -0.15), ("diagnosis_inversion", 0.5, 0.5, -0.25), ("global_diagnosis_inversion_control", 1.0, 0.75, 0.0), ("global_sex_recode_control", 1.0, 0.75, 0.0)]
    got = effects.downstream_report(spark.createDataFrame(rows, "family string, rate double, altered_auc_mean double, auc_delta_mean double")).first()
    assert got["clean_auc"] == 0.75 and got["row_order_50_delta"] == -0.15 and got["row_order_fraction_of_gap"] == pytest.approx(0.6) and got["diagnosis_flip_50_delta"] == -0.25


def test_bundle_evaluation_needs_enough_labels(spark, sf):
    c = cohorts.cohort(spark, sf)
    few = c.select("pos", "diagnosis").limit(6)
    assert effects.evaluate_bundle(few, c).first()["auc"] is None
    whole = effects.evaluate_bundle(c.select("pos", "diagnosis"), c).first()
    assert whole["agree_n"] == whole["n"] and 0 <= whole["auc"] <= 1


def test_a_panel_has_each_case_once(spark):
    files = spark.createDataFrame([("a", "s", "workbook", "mixed"), ("b", "s", "table", "scanner_or_site_metadata")], "artifact_id string, study string, kind string, role string")
    cases = panel.file_cases(files)
    got = {(r["base_artifact"], r["error_family"]): r["proposal"] for r in cases.collect()}
    assert len(got) == 5 and got["a", "role_misclassification"] == "demographics" and got["b", "role_misclassification"] == "unknown"
    assert panel.build([cases]).count() == 5
    with pytest.raises(Exception, match="case_id occurs twice"):
        panel.build([cases, cases]).collect()
    columns = spark.createDataFrame([("a", "s", "1", "x", "cognitive_domain"), ("a", "s", "1", "y", "imaging_feature")], "artifact_id string, study string, sheet string, column_name string, concept string")
    assert sorted(r["proposal"] for r in panel.column_cases(columns).collect()) == ["clinical_scale", "cognitive_domain"]
    public, oracle = panel.split_oracle(cases, ["correct_label", "correct_action"], ["case_id"])
    assert "correct_label" not in public.columns and oracle.columns == ["case_id", "correct_label", "correct_action"]


def test_row_counts_and_scalars(spark):
    from attestra.functions import scalar as S

    df = spark.range(5)
    linkage.require_row_counts({"a": df}, {"a": 5})
    with pytest.raises(ValueError, match="expected 4 rows of a, found 5"):
        linkage.require_row_counts({"a": df}, {"a": 4})
    rows = spark.createDataFrame([(bytearray(b"ab\xff"), float("nan"))], "b binary, x double")
    got = rows.select(S.attribute_text("b").alias("b"), S.safe_scalar("x", "double").alias("x")).first()
    assert got["b"] == "ab�" and got["x"] is None
    cards = linkage.overlap_cards([("none", df.limit(0), "id", df.limit(0), "id"), ("some", df, "id", df, "id")]).collect()
    assert {(r["card"], r["left_n"], r["relationship"]) for r in cards} == {("none", 0, "one_to_one_technical_overlap"), ("some", 5, "one_to_one_technical_overlap")}


def test_columns_and_cards_that_are_asked_for(spark):
    from attestra.functions import scalar as S

    df = spark.createDataFrame([(["id", "age"], ["age", "sex"], 3, 4, 1), ([], None, 0, 0, None)], "required array<string>, names array<string>, a int, b int, diagnosis int")
    assert profile.existing_columns(df, ["a", "zz", "b"]) == (["a", "b"], ["zz"])
    got = df.select(profile.missing_required(F.col("required"), F.coalesce("names", F.array().cast("array<string>"))).alias("m"), S.fraction_text(F.col("a"), F.col("b")).alias("f"), S.is_case("diagnosis").alias("c")).collect()
    assert [tuple(r) for r in got] == [(["id"], "3/4", 1), ([], "0/0", 0)]
    cards = spark.createDataFrame([("f", "age", "c1"), ("f", "sex", "c2"), ("f", "sex", "c3")], "artifact_id string, column_name string, card_id string")
    asked = spark.createDataFrame([("f", "age"), ("f", "sex"), ("f", "zz")], "artifact_id string, column_name string")
    found = {r["column_name"]: (r["state"], r["card_id"]) for r in profile.resolve_column_cards(asked, cards).collect()}
    assert found == {"age": ("resolved", "c1"), "sex": ("ambiguous", None), "zz": ("missing", None)}
