"""The bounded decision loop: a predictor proposes, tools answer, the gate decides.

A turn is a column expression over one row a case, so that the loop is budget + 2 narrow steps and no
shuffle. Each turn's state is written to the shared folder: a lost executor repeats one turn, and a
model behind the predictor isn't asked again. Predictors are functions (cases, turn) -> cases with a
column raw; one that calls a model would be a mapInArrow.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..session import materialize
from . import gate

Predictor = Callable[[DataFrame, int], DataFrame]
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)


def first_object_text(text: str | None) -> str | None:
    """The first JSON object in a text, fences and prose around it left aside; null without one."""
    if text is None:
        return None
    text, decoder, at = _FENCE.sub("", text.strip()), json.JSONDecoder(), -1
    while (at := text.find("{", at + 1)) >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            continue
        return json.dumps(value, sort_keys=True)
    return None


def first_object(raw: Column) -> Column:
    def work(texts: pd.Series) -> pd.Series:
        return texts.map(first_object_text)

    return F.pandas_udf(work, "string")(raw)


def parsed(raw: Column) -> dict[str, Column]:
    """Columns of a raw output: obj, tool, is_tool, action, label, repair, flag, unresolved."""
    whole = first_object(raw)
    inner = F.get_json_object(whole, "$.candidate")
    obj = F.when(inner.startswith("{"), inner).otherwise(whole)
    get = lambda k: F.get_json_object(obj, f"$.{k}")
    tool = S.first_truthy(get("tool_name"), get("tool"))
    kind = F.lower(F.coalesce(S.first_truthy(get("type"), get("kind")), F.lit("candidate")))
    nested = F.coalesce(inner.startswith("{"), F.lit(False))
    return {
        "obj": obj,
        "tool": F.coalesce(tool, F.lit("")),
        "is_tool": ~nested & (tool.isNotNull() | kind.isin("tool", "tool_call", "call_tool")),
        "raw_action": F.lower(F.coalesce(get("action"), F.lit(""))),
        "raw_label": S.first_truthy(get("label"), get("primary_label"), get("primary_candidate")),
        "raw_repair": F.to_json(F.try_parse_json(get("repair"))),
        "flag": get("proposal_matches_my_label").try_cast("boolean"),
        "open_points": S.first_truthy(get("unresolved"), get("uncertainty_reasons")),
    }


def allowed(cases: DataFrame) -> DataFrame:
    """A commit to a label outside the vocabulary becomes an abstention."""
    outside = F.col("task").isin("T-FILE", "T-COL") & F.col("action").isin(*V.COMMITS) & ~F.coalesce(F.array_contains(gate.allowed_labels(), F.col("label")), F.lit(False))
    none = F.lit(None).cast("string")
    return cases.withColumns(
        {"action": F.when(outside, "abstain").otherwise(F.col("action")), "label": F.when(outside, none).otherwise(F.col("label")), "repair": F.when(outside, none).otherwise(F.col("repair"))}
    )


def _turn(cases: DataFrame, budget: int) -> DataFrame:
    """One raw output applied to every open case."""
    cases = cases.withColumns({f"p_{k}": c for k, c in parsed(F.col("raw")).items()})
    names = {"raw_action": F.col("p_raw_action"), "raw_label": F.col("p_raw_label"), "raw_repair": F.col("p_raw_repair")}
    cases = allowed(gate.normalized(cases.withColumns(names), "observed"))
    cases = cases.withColumn("violation", gate.violation(F.col("action"), F.col("label"), F.col("observed")))
    open_, valid, tool = ~F.col("done"), F.col("p_obj").isNotNull(), F.coalesce(F.col("p_is_tool"), F.lit(False))
    spent, again = F.size("called") >= budget, F.array_contains("called", F.col("p_tool"))
    asks = open_ & valid & tool
    calls = asks & ~spent & ~again
    there = F.array_contains("tools", F.col("p_tool"))
    offers = open_ & valid & ~tool
    accepted = offers & F.col("violation").isNull()
    event = (
        F.when(open_ & ~valid, "invalid_json").when(asks & spent, "budget_exhausted").when(asks & again, "duplicate_tool").when(calls & ~there, "unavailable").when(calls, "ok").when(offers & ~accepted, "rejected")
    )
    one = F.array(F.col("p_tool"))
    after = cases.withColumns(
        {
            "turns": F.col("turns") + open_.cast("int"),
            "parse_success": F.col("parse_success") & (~open_ | valid),
            "history": F.when(event.isNotNull(), F.concat("history", F.array(event))).otherwise(F.col("history")),
            "decided": F.when(accepted, F.struct("action", "label", "repair", F.col("p_flag").alias("flag"))).otherwise(F.col("decided")),
            "new_called": F.when(calls, F.concat("called", one)).otherwise(F.col("called")),
            "new_observed": F.when(calls & there, F.concat("observed", one)).otherwise(F.col("observed")),
            "new_done": F.col("done") | accepted | (asks & spent),
        }
    )
    after = after.withColumns({"called": F.col("new_called"), "observed": F.col("new_observed"), "done": F.col("new_done")})
    spare = [c for c in after.columns if c.startswith(("p_", "new_", "raw"))]
    return after.drop(*spare, "action", "label", "repair", "violation")


def play(cases: DataFrame, predictor: Predictor, budget: int = 4) -> DataFrame:
    """Runs the loop; adds action, label, repair, flag, called, observed, history, turns and parse_success.

    cases: see gate. Unresolved cases fall back, and a commit that the gate would refuse at the end is an
    abstention.
    """
    none = F.array().cast("array<string>")
    start = F.lit(None).cast("struct<action: string, label: string, repair: string, flag: boolean>")
    cases = cases.withColumns({"called": none, "observed": none, "history": none, "turns": F.lit(0), "parse_success": F.lit(True), "done": F.lit(False), "decided": start})
    for turn in range(budget + 2):
        cases = materialize(_turn(predictor(cases, turn), budget), "agent-turn")
    given = F.col("decided").isNotNull()
    governance, fixed = F.col("task") == "T-GOV", F.col("task").isin("T-VAL", "T-ID", "T-GOV")
    cases = cases.withColumns(
        {
            "resolved": given,
            "action": F.when(given, F.col("decided.action")).when(governance, "escalate").otherwise("abstain"),
            "label": F.when(given, F.col("decided.label")).when(fixed, gate.forced_label(F.lit(None).cast("string"))),
            "repair": F.when(given, F.col("decided.repair")),
            "flag": F.col("decided.flag"),
            "called": F.array_sort(F.array_distinct("called")),
            "observed": F.array_sort(F.array_distinct("observed")),
        }
    )
    refused = gate.violation(F.col("action"), F.col("label"), F.col("observed")).isNotNull() & F.col("action").isin(*V.COMMITS)
    none = F.lit(None).cast("string")
    return cases.withColumns(
        {"action": F.when(refused, "abstain").otherwise(F.col("action")), "label": F.when(refused, none).otherwise(F.col("label")), "repair": F.when(refused, none).otherwise(F.col("repair"))}
    ).drop("done", "decided")


def scripted(column: str = "script") -> Predictor:
    """Replays an array of raw outputs."""
    return lambda cases, turn: cases.withColumn("raw", F.get(column, F.lit(turn)))


def shard(cases: DataFrame, pos: str, shards: int, shard_id: int) -> DataFrame:
    return cases.filter(F.pmod(F.col(pos), F.lit(shards)) == shard_id)


def instructions(interface: str) -> Column:
    """The text that goes with a card: what is asked, in which form, and which labels there are."""
    more = ""
    if interface != "hidden":
        more = " A proposal is under review: decide on your own label first, then recover if it differs."
    if interface == "contract":
        more += " Say in proposal_matches_my_label whether it is the same."
    head = "Answer with one JSON object, either a tool request (type tool, tool_name) or a candidate (type candidate, action, label, repair, unresolved)."
    return F.concat(F.lit(head + more + " Labels: "), F.array_join(gate.allowed_labels(), ", "), F.lit("."))
