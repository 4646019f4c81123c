"""Cohort bundles: canonical subjects by guarded lookups, provenance, and a ledger of what is unresolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

FIELDS = ("age", "sex", "diagnosis")


def canonical(subjects: DataFrame, source: DataFrame, study: str, salt: str, codes: dict[str, dict[str, str]]) -> DataFrame:
    """Subjects (pos, analysis_id, age, sex, diagnosis) beside the one source row (key, same fields) of their key.

    Values always are the analysis artifact's; a key that repeats in the source takes none from it. A
    difference in any field sends the row to review.
    """
    norm = S.normalized_identifier
    found = source.select(norm("key").alias("__k"), F.struct(*FIELDS).alias("s")).filter("__k <> ''")
    found = found.groupBy("__k").agg(F.count("*").alias("__n"), F.first("s").alias("s"))
    joined = subjects.withColumn("__k", norm("analysis_id")).join(found, "__k", "left")
    once = F.col("__n") == 1
    text = lambda c, f: S.canonical_code(c, codes.get(f, {}))
    conflict = {f: once & ~S.same_value(F.col(f), F.col("s")[f], "age" if f == "age" else "code", codes.get(f, {})) for f in FIELDS}
    joined = joined.withColumns({f"conflict_{f}": F.coalesce(c, F.lit(False)) for f, c in conflict.items()})
    any_conflict = S.any_of(*[F.col(f"conflict_{f}") for f in FIELDS])
    status = F.when(F.col("__n").isNull(), "not_in_source_table").when(~once, "ambiguous_duplicate_source_key").when(any_conflict, "matched_source_conflict_review").otherwise("matched_verified")
    return joined.select(
        S.masked_key(study, "analysis_id", salt).alias("subject_key"),
        F.lit(study).alias("study"),
        "pos",
        S.output_number(S.as_number("age")).alias("age"),
        text(F.col("sex"), "sex").alias("sex"),
        text(F.col("diagnosis"), "diagnosis").alias("diagnosis"),
        *[F.when(once, F.col("s")[f].cast("string")).alias(f"source_{f}") for f in FIELDS],
        *[f"conflict_{f}" for f in FIELDS],
        status.alias("source_join_status"),
    )


#: Columns of a whole bundle, in order.
FULL_COLUMNS = (
    "cohort", "subject_key", "age", "sex", "diagnosis", "site", "bridge_status", "imaging_order_status", "sfnc_available", "clinical_source_artifact", "clinical_source_join_status",
    "source_age", "source_sex", "source_diagnosis", "source_panss_total", "source_cminds_composite",
)


def whole(subjects: DataFrame, source: DataFrame, bridge: DataFrame, columns: dict[str, str], study: str, artifact: str, salt: str, codes: dict[str, dict[str, str]]) -> DataFrame:
    """A row for each subject (pos, analysis_id, age, sex, diagnosis, site, features) with the values of its one source row.

    columns names the source's columns: key, age, sex, diagnosis and, if it has them, panss_total and cminds_composite.
    The bridge (pos, analysis_id) must have the subjects' identifiers in their order; a difference is an error that shows
    when rows are read. A value that is null is an empty text.
    """
    extra = [c for c in ("panss_total", "cminds_composite") if c in columns]
    taken = source.select(F.col(columns["key"]).alias("key"), *[F.col(columns[f]).alias(f) for f in FIELDS], *[F.col(columns[c]).alias(c) for c in extra])
    found = taken.groupBy(S.normalized_identifier("key").alias("__k")).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__{c}") for c in (*FIELDS, *extra)]).filter("__k <> ''")
    there = bridge.select(F.col("pos").alias("__p"), F.col("analysis_id").alias("__id"))
    rows = subjects.join(there, F.col("pos") == F.col("__p"), "full").withColumn("__same", F.col("analysis_id").eqNullSafe(F.col("__id")))
    rows = rows.withColumn("bridge_status", F.when(F.col("__same"), "exact_id_order").otherwise(F.raise_error(F.lit(f"{study}: identifiers of bridge and features differ in order")).cast("string")))
    rows = rows.withColumn("__k", S.normalized_identifier("analysis_id")).join(found, "__k", "left")
    once = F.col("__n") == 1
    same = {f: S.same_value(F.col(f), F.col(f"__{f}"), "age" if f == "age" else "code", codes.get(f, {})) for f in FIELDS}
    conflict = S.any_of(*[F.coalesce(~c, F.lit(False)) for c in same.values()])
    status = F.when(F.col("__n").isNull(), "not_in_source_table").when(~once, "ambiguous_duplicate_source_key").when(conflict, "matched_source_conflict_review").otherwise("matched_verified")
    number = lambda c: S.output_number(S.as_number(c))
    code = lambda c, f: S.canonical_code(F.col(c), codes.get(f, {}))
    filled = {
        "cohort": F.lit(study), "subject_key": S.masked_key(study, "analysis_id", salt), "age": number("age"), "sex": code("sex", "sex"), "diagnosis": code("diagnosis", "diagnosis"), "site": number("site"),
        "bridge_status": F.col("bridge_status"), "imaging_order_status": F.col("bridge_status"), "sfnc_available": F.when(S.finite_vector("features"), "yes").otherwise("no"),
        "clinical_source_artifact": F.lit(artifact), "clinical_source_join_status": status, "source_age": F.when(once, number("__age")),
        "source_sex": F.when(once, code("__sex", "sex")), "source_diagnosis": F.when(once, code("__diagnosis", "diagnosis")),
        **{f"source_{c}": F.when(once, number(f"__{c}")) for c in extra},
    }
    return rows.select(*[F.coalesce(filled.get(c, F.lit("")), F.lit("")).alias(c) for c in FULL_COLUMNS])


def study_summary(bundle: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("source_join_status") == s)
    return bundle.groupBy("study").agg(
        F.count("*").alias("subjects"),
        F.count_if(F.col("source_join_status").startswith("matched")).alias("matched"),
        status("not_in_source_table").alias("missing"),
        status("ambiguous_duplicate_source_key").alias("duplicate"),
        *[F.count_if(F.col(f"conflict_{f}")).alias(f"conflict_{f}") for f in FIELDS],
        F.count_if(F.col("diagnosis").isin("0", "-1")).alias("other_diagnosis"),
    )


def provenance(bundle: DataFrame, artifact: str, source: str) -> DataFrame:
    """(study, field, artifact, rule, available_n): where each field comes from and how many rows have it."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    fields = [(f, artifact, "canonical_value") for f in FIELDS] + [(f"source_{f}", source, "unique_key_lookup") for f in FIELDS] + [("subject_key", artifact, "salted_digest")]
    row = bundle.groupBy("study").agg(*[filled(f).alias(f) for f, _, _ in fields])
    each = [F.struct(F.lit(f).alias("field"), F.lit(a).alias("artifact"), F.lit(r).alias("rule"), F.col(f).alias("available_n")) for f, a, r in fields]
    return row.select("study", F.explode(F.array(*each)).alias("x")).select("study", "x.*")


def unresolved(summary: DataFrame, sites: bool = False, semantics: Sequence[str] = ()) -> DataFrame:
    """(study, issue, affected_n, severity) of every rule that applies to a study's counts."""
    # fixed values: severities
    def issue(name: str, n: Column, severity: str, always: bool = False) -> Column:
        row = F.struct(F.lit(name).alias("issue"), n.cast("bigint").alias("affected_n"), F.lit(severity).alias("severity"))
        return row if always else F.when(n > 0, row)

    rules = [issue("source_coverage", F.col("missing"), "medium"), issue("duplicate_source_keys", F.col("duplicate"), "high")]
    rules += [issue(f"{f}_conflict", F.col(f"conflict_{f}"), "high" if f == "diagnosis" else "medium") for f in FIELDS]
    rules += [issue(f"{s}_semantics", F.col("matched"), "medium", True) for s in semantics]
    rules += [issue("non_analysis_diagnosis_codes", F.col("other_diagnosis"), "medium"), issue("dose_conversion_policy", F.col("subjects"), "high", True)]
    rules.append(issue("site_codebook_missing", F.col("subjects"), "low", True) if sites else issue("site_missing", F.col("subjects"), "medium", True))
    return summary.select("study", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("study", "x.*")


def selected_decisions(decisions: DataFrame, gated: bool) -> DataFrame:
    """Adds chosen_label, which a bundle may follow, and selection, where it comes from.

    Gated decisions must parse, commit, have a label and leave nothing open. Ungated ones are the last raw output
    (raw_outputs, array of texts) that is a JSON candidate or decision with a label, or else the final label.
    """
    if gated:
        fit = F.col("parse_success") & F.col("action").isin("recover", "accept_provisionally") & F.col("label").isNotNull() & (F.size("unresolved") == 0)
        fit = F.coalesce(fit, F.lit(False))
        return decisions.withColumns({"chosen_label": F.when(fit, F.col("label")), "selection": F.when(fit, "terminal_gated").otherwise("terminal_blocked")})

    def read(raw: Column) -> Column:
        label = S.first_truthy(F.get_json_object(raw, "$.label"))
        kind = F.get_json_object(raw, "$.type").isin("candidate", "decision")
        return F.when(F.try_parse_json(raw).isNotNull() & kind, label)

    offered = F.array_compact(F.transform(F.coalesce("raw_outputs", F.array().cast("array<string>")), read))
    last = F.get(offered, F.size(offered) - 1)
    final = F.when(F.col("label") != "", F.col("label"))
    source = F.when(last.isNotNull(), "raw_candidate_ungated").when(final.isNotNull(), "terminal_fallback_ungated").otherwise("no_candidate")
    return decisions.withColumns({"chosen_label": F.coalesce(last, final), "selection": source})


def derive_mappings(chosen: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(study, target, column_name, n, state): the one column of a study that got the label; others are blocked."""
    hits = chosen.filter(F.col("chosen_label").isin(*targets)).groupBy("study", F.col("chosen_label").alias("target"))
    hits = hits.agg(F.count("*").alias("n"), F.min("column_name").alias("first"))
    wanted = chosen.select("study").distinct().select("study", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("mapped")
    return wanted.join(hits, ["study", "target"], "left").select(
        "study", "target", F.when(F.col("n") == 1, F.col("first")).alias("column_name"), F.coalesce("n", F.lit(0)).alias("n"), state.alias("state")
    )


#: Column of an agent's bundle that each target fills. Fixed values.
AGENT_FIELDS = {"current_age": "age", "sex_or_gender": "sex", "diagnosis": "diagnosis", "panss_total": "source_panss_total", "cognitive_domain": "source_cminds_composite"}


def mapping_of(ledger: DataFrame, study: str) -> dict[str, str]:
    """Target to column of one study's authorised mappings: a row for each target at most."""
    return {r["target"]: r["column_name"] for r in ledger.filter((F.col("study") == study) & (F.col("state") == "mapped")).select("target", "column_name").collect()}


def agent_bundle(subjects: DataFrame, source: DataFrame, mapping: dict[str, str], study: str, artifact: str, salt: str, codes: dict[str, dict[str, str]]) -> DataFrame:
    """Subjects (pos, analysis_id, age, sex, diagnosis, site, features) with values from the source columns that decisions chose.

    What the analysis artifact says stays beside them for comparison only. Without a mapped identifier no row is
    joined, and a key that repeats in the source gives no values; fields without a mapping stay empty.
    """
    norm, key = S.normalized_identifier, mapping.get("subject_identifier")
    chosen = {t: c for t, c in mapping.items() if t in AGENT_FIELDS}
    joined = subjects.withColumn("__k", norm("analysis_id"))
    if key:
        found = source.select(norm(key).alias("__k"), F.struct(F.lit(0).alias("__"), *[F.col(c).cast("string").alias(t) for t, c in chosen.items()]).alias("s")).filter("__k <> ''")
        joined = joined.join(found.groupBy("__k").agg(F.count("*").alias("__n"), F.first("s").alias("s")), "__k", "left")
    else:
        joined = joined.withColumns({"__n": F.lit(None).cast("bigint"), "s": F.struct(*[F.lit(None).cast("string").alias(t) for t in chosen or {"__": ""}])})
    once = F.col("__n") == 1

    def value(target: str, c: Column) -> Column:
        if target in ("sex_or_gender", "diagnosis"):
            return S.canonical_code(c, codes.get(AGENT_FIELDS[target], {}))
        return S.output_number(S.as_number(c))

    filled = {AGENT_FIELDS[t]: F.coalesce(F.when(once, value(t, F.col("s")[t])), F.lit("")) for t in chosen}
    empty = F.lit("")
    reference = {"age": S.output_number(S.as_number("age")), "sex": S.canonical_code(F.col("sex"), codes.get("sex", {})), "diagnosis": S.canonical_code(F.col("diagnosis"), codes.get("diagnosis", {}))}
    return joined.select(
        F.lit(study).alias("cohort"),
        S.masked_key(study, "analysis_id", salt).alias("subject_key"),
        *[filled.get(f, empty).alias(f) for f in FIELDS],
        S.output_number(S.as_number("site")).alias("site"),
        F.lit("exact_id_order").alias("bridge_status"),
        F.when(S.finite_vector("features"), "yes").otherwise("no").alias("sfnc_available"),
        F.lit(artifact).alias("agent_source_artifact"),
        F.when(once, "matched_unique").when(F.col("__n") > 1, "duplicate_key").otherwise("not_in_source").alias("agent_join_status"),
        *[c.alias(f"analysis_reference_{f}") for f, c in reference.items()],
        *[empty.alias(f"source_{f}") for f in FIELDS],
        *[filled.get(f, empty).alias(f) for f in ("source_panss_total", "source_cminds_composite")],
    )


def agent_unresolved(ledger: DataFrame, subjects: DataFrame, artifact: str) -> DataFrame:
    """(issue_id, cohort, scope, affected_n, source_artifact, severity, action) of each target without an authorised column."""
    n = F.broadcast(subjects.agg(F.count("*").alias("affected_n")))  # one row
    severe = F.col("target").isin("subject_identifier", "diagnosis")
    rows = ledger.filter("state <> 'mapped'").crossJoin(n)
    return rows.select(
        F.concat(F.lower("study"), F.lit("_"), "target", F.lit("_mapping")).alias("issue_id"), F.col("study").alias("cohort"), F.col("target").alias("scope"), "affected_n",
        F.lit(artifact).alias("source_artifact"), F.when(severe, "high").otherwise("medium").alias("severity"), F.lit("human_review_or_add_evidence").alias("action"),
    )


def agent_summary(bundle: DataFrame) -> DataFrame:
    """Counts of an agent's bundle by cohort: joins and filled fields."""
    filled = lambda c: F.count_if(F.col(c) != "")
    return bundle.groupBy("cohort").agg(
        F.count("*").alias("n_subjects"), F.count_if(F.col("agent_join_status") == "matched_unique").alias("source_matched_n"), F.count_if(F.col("agent_join_status") == "duplicate_key").alias("source_duplicate_n"),
        filled("age").alias("age_coverage_n"), filled("sex").alias("sex_coverage_n"), filled("diagnosis").alias("diagnosis_coverage_n"),
    )
