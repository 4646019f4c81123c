"""Case panels: clean rows and seeded corruptions with their oracles, and the synthetic tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from .gate import canonical, mapping_repair
from .positions import positions

#: Hashes are ranked in ranges of this width: 65,536 of them cover all longs.
_HASH_RANGE = 1 << 48


def counts(cases: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for each of the dimensions."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("x")
    return cases.select(each).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def split_oracle(cases: DataFrame, oracle: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What predictors may see, and the oracle beside the keys."""
    return cases.drop(*oracle), cases.select(*keys, *oracle)


def chosen_rows(df: DataFrame, pos: str, by: Sequence[str], seed: str, rate: str) -> DataFrame:
    """Adds chosen: the round(rate * n) rows of least hash in each group, n and k; halves round to even."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    hashed = df.withColumn("__h", F.xxhash64(pos, seed))
    ranked = positions(hashed, "__h", "__rank", by, _HASH_RANGE).join(sizes, list(by))
    k = F.bround(F.col(rate) * F.col("n"), 0).cast("bigint")
    return ranked.withColumn("k", k).withColumn("chosen", F.col("__rank") <= k).drop("__h", "__rank")


def rotate(df: DataFrame, pos: str, values: Sequence[str], by: Sequence[str], forward: bool = True) -> DataFrame:
    """Chosen rows take the values of the next chosen row (or the one before), the last the first's.

    All values move together; each comes back as new_<name>. One chosen row keeps its own.
    """
    picked = positions(df.filter("chosen").select(*by, pos, "k", *values), pos, "__slot", by)
    target = F.pmod(F.col("__slot") - 2, F.col("k")) + 1 if forward else F.pmod(F.col("__slot"), F.col("k")) + 1
    given = picked.select(*by, target.alias("__slot"), *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("__moved"))
    slots = picked.select(*by, pos, "__slot").join(given, [*by, "__slot"]).drop("__slot")
    joined = df.join(slots, [*by, pos], "left")
    moved = F.coalesce(F.col("__moved"), F.lit(False))
    return joined.withColumns({f"new_{v}": F.when(moved, F.col(f"new_{v}")).otherwise(F.col(v)) for v in values}).drop("__moved")


def corruption_grid(keys: DataFrame, grid: Sequence[tuple[float, int]]) -> DataFrame:
    """Row-order corruption of (pos, key) for each (rate, seed): how many rows were chosen and moved."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(s).alias("seed")) for r, s in grid])).alias("c")
    rows = keys.select("pos", "key", cells).select("pos", "key", "c.rate", "c.seed")
    by = ["rate", "seed"]
    done = rotate(chosen_rows(rows, "pos", by, "seed", "rate"), "pos", ["key"], by)
    changed = ~F.col("key").eqNullSafe(F.col("new_key"))
    return done.groupBy(*by).agg(F.count("*").alias("n"), F.max("k").alias("chosen"), F.count_if(changed).alias("moved"), F.count_distinct("new_key").alias("overlap_n"))


# --- cases from cards


def file_cases(files: DataFrame) -> DataFrame:
    """Clean role, wrong role, and for workbooks a parser failure with a tempting name.

    files: artifact_id, study, kind, role. Each row meets three scenarios.
    """
    scenario = F.explode(F.array(*map(F.lit, ("clean_role", "role_misclassification", "parser_failure_with_tempting_name")))).alias("error_family")
    rows = files.select("*", scenario).filter((F.col("error_family") != "parser_failure_with_tempting_name") | (F.col("kind") == "workbook"))
    wrong = S.first_match([(F.col("role") == k, v) for k, v in V.WRONG_ROLE.items()], V.OTHER_WRONG_ROLE)
    clean = F.col("error_family") == "clean_role"
    failed = F.col("error_family") == "parser_failure_with_tempting_name"
    return rows.select(
        S.case_id(F.lit("T-FILE"), "artifact_id", "error_family").alias("case_id"), "study", F.lit("T-FILE").alias("task"), "error_family", F.col("artifact_id").alias("base_artifact"),
        F.when(clean, F.col("role")).otherwise(wrong).alias("proposal"),
        F.when(failed, "injected_parser_failure").otherwise("parsed").alias("parser_status"),
        (~clean).alias("corruption_present"),
        F.when(clean, "accept_provisionally").otherwise("recover").alias("correct_action"),
        F.col("role").alias("correct_label"),
        F.when(failed, canonical(("parser_status", F.lit("parsed")), ("primary_role", F.col("role")))).when(~clean, canonical(("primary_role", F.col("role")))).alias("correct_repair"),
        F.array(F.array(F.lit("reparse_artifact"))).alias("required"),
        F.lit("curated_structural_provisional").alias("oracle_status"),
    )


def column_cases(columns: DataFrame) -> DataFrame:
    """Clean and substituted concepts; columns: artifact_id, study, sheet, column_name, concept.

    The sheet is part of the id, so that one column on two sheets makes two cases. Concepts without a substitute make none.
    """
    wrong = F.coalesce(*[F.when(F.col("concept") == k, v) for k, v in V.WRONG_CONCEPT.items()])
    columns = columns.filter(F.col("concept").isin(*V.WRONG_CONCEPT))
    rows = columns.select("*", F.explode(F.array(F.lit("clean_concept"), F.lit("concept_substitution"))).alias("error_family"))
    clean = F.col("error_family") == "clean_concept"
    sensitive = F.col("concept").isin(*V.SENSITIVE_CONCEPTS)
    return rows.select(
        S.case_id(F.lit("T-COL"), "artifact_id", "sheet", "column_name", "error_family").alias("case_id"), "study", F.lit("T-COL").alias("task"), "error_family", F.col("artifact_id").alias("base_artifact"),
        F.when(clean, F.col("concept")).otherwise(wrong).alias("proposal"),
        (~clean).alias("corruption_present"),
        F.when(clean, "accept_provisionally").otherwise("recover").alias("correct_action"),
        F.col("concept").alias("correct_label"),
        F.when(~clean, canonical(("concept", F.col("concept")))).alias("correct_repair"),
        F.when(sensitive, F.array(F.array(F.lit("profile_values")))).otherwise(F.array(F.array().cast("array<string>"))).alias("required"),
        F.lit("curated_semantic_provisional").alias("oracle_status"),
    )


def encoding_cases(codes: DataFrame) -> DataFrame:
    """Clean mapping, mapping with its values reversed, and one without a reference (to abstain from).

    codes: artifact_id, study, column_name, mapping, reference (the verifying tool).
    """
    rows = codes.select("*", F.explode(F.array(*map(F.lit, ("clean_encoding", "code_direction_inversion", "encoding_without_decisive_reference")))).alias("error_family"))
    clean, inverted = F.col("error_family") == "clean_encoding", F.col("error_family") == "code_direction_inversion"
    turned = F.map_from_arrays(F.map_keys("mapping"), F.reverse(F.map_values("mapping")))
    none = F.array().cast("array<string>")
    return rows.select(
        S.case_id(F.lit("T-VAL"), "artifact_id", "column_name", "error_family").alias("case_id"), "study", F.lit("T-VAL").alias("task"), "error_family", F.col("artifact_id").alias("base_artifact"),
        F.when(inverted, turned).otherwise(F.col("mapping")).alias("proposed_mapping"),
        (~clean).alias("corruption_present"),
        F.when(clean, "accept_provisionally").when(inverted, "recover").otherwise("abstain").alias("correct_action"),
        F.lit("value_encoding").alias("correct_label"),
        F.when(inverted, mapping_repair(F.col("mapping"))).alias("correct_repair"),
        F.array(F.when(clean | inverted, F.array("reference")).otherwise(none)).alias("required"),
        F.when(clean | inverted, "source_explicit").otherwise("procedural_missing_evidence").alias("oracle_status"),
    )


def linkage_cases(cards: DataFrame) -> DataFrame:
    """Clean relationship and an over-claim of identity, for cards without an order check."""
    rows = cards.filter("order_agreement IS NULL").select("*", F.explode(F.array(F.lit("clean_identifier_linkage"), F.lit("identifier_identity_overclaim"))).alias("error_family"))
    clean = F.col("error_family") == "clean_identifier_linkage"
    return rows.select(
        S.case_id(F.lit("T-ID"), "card_id", "error_family").alias("case_id"), "study", F.lit("T-ID").alias("task"), "error_family", F.col("card_id").alias("base_artifact"),
        F.col("relationship").alias("proposed_relationship"), (~clean).alias("proposed_identity_proven"), (~clean).alias("corruption_present"),
        F.when(clean, "accept_provisionally").otherwise("recover").alias("correct_action"), F.lit("identifier_linkage").alias("correct_label"),
        F.when(~clean, canonical(("identity_proven", F.lit(False)), ("relationship", F.col("relationship")))).alias("correct_repair"),
        F.array(F.array(F.lit("check_id_overlap"))).alias("required"), F.lit("aggregate_operational").alias("oracle_status"),
    )


def lineage_cases(pairs: DataFrame) -> DataFrame:
    """Recorded dependence of two files of one lineage, and the claim that they are independent."""
    rows = pairs.select("*", F.explode(F.array(F.lit("clean_lineage_status"), F.lit("duplicate_lineage_independence_overclaim"))).alias("error_family"))
    clean = F.col("error_family") == "clean_lineage_status"
    same = F.lit("nonindependent_same_lineage")
    return rows.select(
        S.case_id(F.lit("T-ID"), "left_member", "right_member", "error_family").alias("case_id"), F.lit("T-ID").alias("task"), "error_family", "left_member", "right_member",
        F.when(clean, same).otherwise("independent_distinct_lineage").alias("proposed_independence"), (~clean).alias("corruption_present"),
        F.when(clean, "accept_provisionally").otherwise("recover").alias("correct_action"), F.lit("source_independence").alias("correct_label"),
        F.when(~clean, canonical(("independence_status", same))).alias("correct_repair"), F.array(F.array(F.lit("check_lineage"))).alias("required"), F.lit("recorded_provenance").alias("oracle_status"),
    )


def governance_cases(definitions: DataFrame) -> DataFrame:
    """Proposals that only people may decide; definitions: artifact_id, study, concept, proposal, reason."""
    return definitions.select(
        S.case_id(F.lit("T-GOV"), "artifact_id", "concept").alias("case_id"), "study", F.lit("T-GOV").alias("task"), F.col("concept").alias("error_family"), F.col("artifact_id").alias("base_artifact"),
        "proposal", F.lit(True).alias("corruption_present"), F.lit("escalate").alias("correct_action"), F.col("concept").alias("correct_label"), F.lit(None).cast("string").alias("correct_repair"),
        F.array(F.array(F.lit("escalate_to_human"))).alias("required"), F.lit("procedural_human_owned").alias("oracle_status"), F.col("reason").alias("evidence_basis"),
    )


PANEL_COLUMNS = ("case_id", "study", "task", "error_family", "base_artifact", "corruption_present", "correct_action", "correct_label", "correct_repair", "required", "oracle_status")


def build(parts: Sequence[DataFrame]) -> DataFrame:
    """One panel of several kinds of cases; a case id that occurs twice is an error, found while the rows are read.

    The count of each id travels with its cases, so that no separate job is needed.
    """
    whole = None
    for part in parts:
        part = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in PANEL_COLUMNS])
        whole = part if whole is None else whole.unionByName(part)
    again = whole.groupBy("case_id").agg(F.first(F.struct(*PANEL_COLUMNS[1:])).alias("c"), F.count("*").alias("times"))
    once = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("case_id occurs twice: "), "case_id")).cast("boolean")).otherwise(True)
    return again.filter(once).select("case_id", "c.*")


def card_index(cards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, state) of cards: which keys name one card and which are ambiguous."""
    state = F.when(F.col("n") > 1, "duplicate").otherwise("unique")
    return cards.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("state", state)


# --- the synthetic panel's tables, closed forms of a row number


def synthetic_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Five small tables of sixty subjects."""
    k = F.col("id")
    base = spark.range(60)
    code = F.format_string("SYN_A_%04d", k + 1)
    age, sex, panss, cpz = 20 + (7 * (k + 1)) % 45, 1 + (k + 1) % 2, 8 + (3 * k) % 28, 50 + 2.5 * k
    edge1, edge2 = F.round(0.1 + k / 100, 3), F.round(0.2 + (k % 11) / 100, 3)
    dictionary = [("dx_code", "0", "control"), ("dx_code", "1", "case"), ("sex_code", "1", "male"), ("sex_code", "2", "female")]
    return {
        "site_a_demographics": base.select(code.alias("participant_code"), age.alias("age_years"), sex.alias("sex_code"), F.lit("A").alias("site")),
        "site_a_clinical": base.select(code.alias("subj_id"), (1 + k % 3).alias("visit"), (k % 2).alias("dx_code"), panss.alias("panss_total"), cpz.alias("cpz_mg_day")),
        "site_a_dictionary": spark.createDataFrame(dictionary, "variable string, code string, meaning string"),
        "site_a_sfnc_summary": base.select(code.alias("participant_code"), k.alias("row_index"), edge1.alias("edge_001"), edge2.alias("edge_002")),
        "site_a_mixed_export": base.select(code.alias("ID"), age.alias("Age"), sex.alias("Sex"), panss.alias("PANSS_total"), cpz.alias("CPZ")),
    }


def synthetic_cases(spark: SparkSession, pairs: int = 12, strict_reference: bool = False) -> DataFrame:
    """Ninety cases at twelve pairs: file and column pairs, six each of encodings, identifiers and governance.

    With strict_reference a corrupted proposal that happens to be right still counts as corrupted.
    """
    roles = F.array(*map(F.lit, ("demographics", "clinical_scale", "dictionary_or_codebook", "imaging_derivative", "mixed")))
    concepts = F.array(*map(F.lit, ("subject_identifier", "current_age", "sex_or_gender", "diagnosis", "panss_total", "medication_dose")))

    def paired(task: str, n: int, labels: object, tempting: str) -> DataFrame:
        rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(False), F.lit(True))).alias("corrupted"))
        rows = rows.withColumn("true", F.get(labels, (F.col("i") % F.size(labels)).cast("int")))
        wrong = F.lit(tempting) if strict_reference else F.when(F.col("true") == tempting, "mixed" if task == "T-FILE" else "site_identifier").otherwise(tempting)
        key = "primary_role" if task == "T-FILE" else "concept"
        return rows.select(
            S.case_id(F.lit(task), "i", "corrupted").alias("case_id"), F.lit(task).alias("task"), F.when(F.col("corrupted"), "misclassification").otherwise("clean").alias("error_family"),
            F.when(F.col("corrupted"), wrong).otherwise(F.col("true")).alias("proposal"), F.col("corrupted").alias("corruption_present"),
            F.when(F.col("corrupted"), "recover").otherwise("accept_provisionally").alias("correct_action"), F.col("true").alias("correct_label"),
            F.when(F.col("corrupted"), canonical((key, F.col("true")))).alias("correct_repair"), F.lit("synthetic_exact").alias("oracle_status"),
        )

    def single(task: str, label: str, actions: tuple[str, str]) -> DataFrame:
        odd = F.col("id") % 2 == 1
        return spark.range(pairs // 2).select(
            S.case_id(F.lit(task), "id").alias("case_id"), F.lit(task).alias("task"), F.when(odd, "changed").otherwise("clean").alias("error_family"), F.lit(None).cast("string").alias("proposal"),
            (odd & F.lit(task != "T-GOV")).alias("corruption_present"), F.when(odd, actions[1]).otherwise(actions[0]).alias("correct_action"), F.lit(label).alias("correct_label"),
            F.when(odd & F.lit(actions[1] == "recover"), F.lit('{"operation":"restore"}')).alias("correct_repair"), F.lit("synthetic_exact").alias("oracle_status"),
        )

    parts = [
        paired("T-FILE", pairs, roles, "demographics"), paired("T-COL", 2 * pairs, concepts, "diagnosis"), single("T-VAL", "value_encoding", ("accept_provisionally", "recover")),
        single("T-ID", "imaging_row_alignment", ("accept_provisionally", "recover")), single("T-GOV", "release_policy", ("escalate", "escalate")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
