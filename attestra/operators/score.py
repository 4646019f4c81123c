"""Scores of decisions against their oracle: per case, in groups, and between arms.

scored() takes one row a case with gold_action, gold_label, gold_repair, required (array of sets of
tools), gold_corruption and the predicted action, label, repair, called, observed and history (array of
event names). Means over nothing are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from .linkage import satisfied

EVENTS = {"unavailable_tool_calls": "unavailable", "duplicate_tool_events": "duplicate_tool", "gate_rejections": "rejected", "invalid_json_events": "invalid_json", "budget_exhaustion_events": "budget_exhausted"}


def _events(name: str) -> Column:
    return F.size(F.filter("history", lambda h: h == name)).cast("bigint")


def scored(rows: DataFrame) -> DataFrame:
    """Adds the metrics of each case."""
    observed = F.coalesce("observed", "called")
    decisive = F.array_distinct(F.flatten("required"))
    relevant = F.size(F.filter("called", lambda t: F.array_contains(decisive, t)))
    first = rows.withColumns(
        {
            "action_correct": F.col("action").eqNullSafe(F.col("gold_action")),
            "label_correct": F.col("label").eqNullSafe(F.col("gold_label")),
            "exact_repair": F.col("repair").eqNullSafe(F.col("gold_repair")),
            "pred_label_missing": F.col("label").isNull(),
            "decisive_evidence_acquired": satisfied(F.col("required"), observed),
            "evidence_required": F.exists("required", lambda r: F.size(r) > 0),
            "committed": F.coalesce(F.col("action").isin(*V.COMMITS), F.lit(False)),
            "calls": F.size("called").cast("bigint"),
            "observed_evidence_n": F.size(observed).cast("bigint"),
            "nonminimal_calls": (F.size("called") - relevant).cast("bigint"),
            "relevant_tool_precision": F.try_divide(relevant, F.size("called")),
            "predicted_intervention": ~F.col("action").eqNullSafe(F.lit("accept_provisionally")),
            **{name: _events(event) for name, event in EVENTS.items()},
        }
    )
    second = first.withColumn("evidence_supported", ~F.col("evidence_required") | F.col("decisive_evidence_acquired"))
    third = second.withColumn("case_success", F.col("action_correct") & F.col("label_correct") & F.col("exact_repair") & F.col("evidence_supported"))
    return third.withColumn("unsafe_commit", F.col("committed") & ~F.col("case_success"))


#: What a run may tell of a case, and what stands if it doesn't.
RUN = {
    "parse_success": ("boolean", True), "model_path": ("string", None), "condition": ("string", None), "run_seed": ("bigint", None), "excluded_tools": ("array<string>", None),
    "unresolved": ("array<string>", None), "inference_seconds": ("double", 0.0), "input_tokens": ("bigint", 0), "output_tokens": ("bigint", 0),
}
#: Columns of a table of cases, in order.
CASE_COLUMNS = (
    "case_id", "study", "task", "error_family", "base_artifact", "lineage_group", "oracle_status", "gold_corruption", "gold_action", "pred_action", "gold_label", "pred_label", "pred_label_missing",
    "action_correct", "label_correct", "exact_repair", "evidence_supported", "case_success", "committed", "unsafe_commit", "decisive_evidence_acquired", "evidence_required", "calls", "observed_evidence_n",
    "nonminimal_calls", "parse_success", "predicted_intervention", "relevant_tool_precision", *EVENTS, "model_path", "condition", "run_seed", "excluded_tools", "unresolved_n",
    "inference_seconds", "input_tokens", "output_tokens",
)


def case_table(metrics: DataFrame) -> DataFrame:
    """All columns of scored cases and of the run, in a fixed order; what a run doesn't tell has its default."""
    rows = metrics.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in metrics.columns else F.lit(v).cast(kind) for k, (kind, v) in RUN.items()})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "pred_action": F.col("action"), "pred_label": F.col("label"), "oracle_status": F.coalesce("oracle_status", F.lit("unspecified")), "unresolved_n": F.size(F.coalesce("unresolved", none)).cast("bigint"),
        "excluded_tools": F.to_json(F.coalesce("excluded_tools", none)),
    })
    return rows.select(*CASE_COLUMNS)


def share(c: str | Column, where: Column | None = None) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("int")
    return F.avg(x if where is None else F.when(where, x))


def summary_columns(runs: bool = False) -> list[Column]:
    """Metrics of a summary; with runs, also the means of time and tokens."""
    return [
        F.count("*").alias("n"),
        share("case_success").alias("case_success"),
        share("action_correct").alias("action_accuracy"),
        share("label_correct").alias("label_accuracy"),
        share("exact_repair").alias("exact_repair_accuracy"),
        share("unsafe_commit").alias("unsafe_commit_rate"),
        share("committed").alias("coverage"),
        share("unsafe_commit", F.col("committed")).alias("selective_risk"),
        share("decisive_evidence_acquired").alias("decisive_evidence_rate"),
        share("decisive_evidence_acquired", F.col("evidence_required")).alias("decisive_evidence_rate_required"),
        F.avg("calls").alias("mean_calls"),
        F.avg("nonminimal_calls").alias("mean_nonminimal_calls"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("inference_seconds", "input_tokens", "output_tokens") if runs],
    ]


def grouped_summaries(metrics: DataFrame, keys: list[str], runs: bool = False) -> DataFrame:
    """The summary by each key and over all, in one pass: (dimension, value, ...). Null keys make no group."""
    sets = [[F.col(k)] for k in keys] + [[]]
    found = metrics.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__g"), *summary_columns(runs))
    full = (1 << len(keys)) - 1
    by = [(full ^ (1 << (len(keys) - 1 - i)), k) for i, k in enumerate(keys)]
    dimension = S.first_match([(F.col("__g") == g, k) for g, k in by], "all")
    value = reduce(lambda c, gk: c.when(F.col("__g") == gk[0], F.col(gk[1]).cast("string")), by[1:], F.when(F.col("__g") == by[0][0], F.col(by[0][1]).cast("string")))
    found = found.select(dimension.alias("dimension"), value.alias("value"), *[c for c in found.columns if c not in (*keys, "__g")])
    return found.filter((F.col("dimension") == "all") | F.col("value").isNotNull())


def macro_f1(metrics: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean F1 over all labels that are gold or predicted; a label without hits has 0."""
    g, p = S.label_or_missing(gold), S.label_or_missing(pred)
    each = metrics.select(F.explode(F.array(F.struct(g.alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (g == p).cast("int").alias("t")), F.struct(p.alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    counts = each.groupBy("x.label").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"), F.sum("x.t").alias("t"))
    return counts.agg(F.count("*").alias("labels"), F.avg(2 * F.col("t") / (F.col("g") + F.col("p"))).alias("macro_f1"))


def intervention(metrics: DataFrame) -> DataFrame:
    """Precision, recall and F1 of intervening where something was corrupted; governance doesn't count."""
    rows = metrics.filter("task <> 'T-GOV'")
    hit = F.count_if(F.col("predicted_intervention") & F.col("gold_corruption"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    got = rows.agg(hit.alias("tp"), F.count_if("predicted_intervention").alias("pp"), F.count_if("gold_corruption").alias("ap"))
    return got.select("tp", ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("ap")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"))


def headline(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        share("action_correct", F.col("gold_action") == "recover").alias("recovery_accuracy"),
        F.avg("relevant_tool_precision").alias("relevant_tool_precision"),
        share(F.col("action").eqNullSafe(F.lit("abstain"))).alias("abstention_rate"),
        share(F.col("action").eqNullSafe(F.lit("escalate"))).alias("escalation_rate"),
        share("parse_success").alias("parse_rate"),
        *[F.avg(e).alias(f"mean_{e}") for e in EVENTS],
    )


def arm_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    target = F.col("gold_repair").isNotNull()
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n"),
        share("label_correct").alias("label_accuracy"),
        share("action_correct").alias("action_accuracy"),
        share("case_success").alias("case_success"),
        share("unsafe_commit").alias("unsafe_rate"),
        share("committed").alias("coverage"),
        F.count_if("committed").alias("committed_n"),
        F.count_if(F.col("committed") & F.col("unsafe_commit")).alias("unsafe_n"),
        F.count_if(target).alias("repair_targets"),
        F.count_if(target & F.col("exact_repair")).alias("repairs"),
    )


def contract_compliance(rows: DataFrame, flag: str = "matches_flag") -> DataFrame:
    f = F.col(flag)
    return rows.agg(F.count("*").alias("n"), F.count_if(f.isNotNull()).alias("present"), F.count_if(f).alias("true_n"), F.count_if(~f).alias("false_n"), F.count_if(f.isNull()).alias("missing"))


def _contradiction(suffix: str) -> Column:
    """The label differs from the proposal, and yet the action isn't recover."""
    return ~F.col(f"action{suffix}").eqNullSafe(F.lit("recover")) & ~F.col(f"label{suffix}").eqNullSafe(F.col("proposal"))


def ucr_intersection(hidden: DataFrame, visible: DataFrame) -> DataFrame:
    """Unresolved contradictions in corrupted semantic cases that both arms label correctly."""
    cols = ("case_id", "action", "label", "label_correct")
    a = hidden.filter(F.col("task").isin("T-FILE", "T-COL") & F.col("gold_corruption")).select(*cols, "proposal")
    b = visible.select("case_id", *[F.col(c).alias(f"{c}_v") for c in cols[1:]])
    both = a.join(b, "case_id").filter("label_correct AND label_correct_v")
    return both.agg(F.count("*").alias("n"), F.count_if(_contradiction("")).alias("hidden"), F.count_if(_contradiction("_v")).alias("visible"))


def contradictory_approvals(metrics: DataFrame) -> DataFrame:
    rows = metrics.filter(F.col("task").isin("T-FILE", "T-COL") & F.col("gold_corruption"))
    accepted = F.col("action").eqNullSafe(F.lit("accept_provisionally")) & F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("proposal"))
    return rows.agg(F.count("*").alias("n"), F.count_if(accepted).alias("contradictory"))


def _long(df: DataFrame, section: str, *keys: str) -> DataFrame:
    """(section, arm, metric, value) of one row for each arm."""
    metrics = [c for c in df.columns if c not in keys]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    arm = F.col(keys[0]) if keys else F.lit("hidden_visible")
    return df.select(F.lit(section).alias("section"), arm.alias("arm"), each).select("section", "arm", "x.*")


def report(arms: DataFrame, hidden: str = "hidden", visible: str = "visible") -> DataFrame:
    """(section, arm, metric, value): metrics of every arm, flags and contradictory approvals, and what both arms leave unresolved.

    arms: scored rows of all arms with a column `arm` (for several models, model and arm in one name).
    """
    by = lambda f: f(arms.groupBy("arm"))
    flag = F.col("matches_flag")
    contract = by(lambda g: g.agg(F.count("*").alias("n"), F.count_if(flag.isNotNull()).alias("present"), F.count_if(flag).alias("true_n")))
    semantic = F.col("task").isin("T-FILE", "T-COL") & F.col("gold_corruption")
    accepted = F.col("action").eqNullSafe(F.lit("accept_provisionally")) & F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("proposal"))
    approvals = by(lambda g: g.agg(F.count_if(semantic).alias("n"), F.count_if(semantic & accepted).alias("contradictory")))
    both = ucr_intersection(arms.filter(F.col("arm") == hidden), arms.filter(F.col("arm") == visible))
    parts = [_long(arm_metrics(arms, "arm"), "arms", "arm"), _long(contract, "contract", "arm"), _long(approvals, "contradictory_approvals", "arm"), _long(both, "ucr_intersection")]
    return reduce(DataFrame.unionByName, parts)
