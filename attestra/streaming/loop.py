"""The decision loop as a stream: raw outputs of predictors come in, an append-only log of turns goes out.

What an output says, and what the gate would ask of its decision, are column expressions; only what earlier turns have
done is state: the tools called and observed, how many turns there were, and outputs that came too early. Outputs of a case
take effect in the order of their turns, whenever they come; one that comes again is left aside. State and log are kept by
the checkpoint, so that a query that stops and starts again goes on without losing or repeating a turn.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import vocabulary as V
from ..operators import agent, gate
from .stream import run_available

#: Tools that the gate can ask for.
GATE_TOOLS = ("reparse_artifact", "profile_values", *V.VERIFIERS, *V.SCOPE_TOOLS.values(), "escalate_to_human")
LOG = "case_id string, turn int, event string, tool string, accepted boolean, closed boolean, called array<string>, observed array<string>, raw string"
_READ = ("turn", "raw", "valid", "is_tool", "tool", "there", "refused", "satisfied_by")
#: State is kept by buckets of cases, as a call and a state of its own for each case cost more than its turns. Fixed value: the keys of
#: every checkpoint depend on it.
_BUCKETS = 1 << 14


def understood(outputs: DataFrame) -> DataFrame:
    """Outputs (a case's columns, turn, raw) with what they ask for and what would satisfy the gate.

    A decision is refused while no tool is observed, or whatever is observed; each reason of the gate is lifted by any one
    of some tools, which are found by asking it with one tool at a time.
    """
    rows = outputs.withColumns({f"p_{k}": c for k, c in agent.parsed(F.col("raw")).items()})
    names = {f"raw_{k}": F.col(f"p_raw_{k}") for k in ("action", "label", "repair")}
    rows = agent.allowed(gate.normalized(rows.withColumns({**names, "__none": F.array().cast("array<string>")}), "__none"))
    asked = lambda tools: gate.violation(F.col("action"), F.col("label"), tools)
    refused = asked(F.col("__none")).isNotNull()
    lifts = [F.when(asked(F.array(F.lit(t))).isNull(), F.lit(t)) for t in GATE_TOOLS]
    return rows.select(
        "case_id", F.col("turn").cast("int").alias("turn"), "raw", F.col("p_obj").isNotNull().alias("valid"), F.coalesce("p_is_tool", F.lit(False)).alias("is_tool"), F.col("p_tool").alias("tool"),
        F.coalesce(F.array_contains("tools", F.col("p_tool")), F.lit(False)).alias("there"), refused.alias("refused"), F.when(refused, F.array_compact(F.array(*lifts))).otherwise(F.col("__none")).alias("satisfied_by"),
    )


def _played(turn: int, called: list[str], observed: list[str], waiting: dict[int, list], budget: int) -> tuple[list[tuple], list | None]:
    """The turns of one case that are complete now, as rows of the log without the case, and what is kept of it; None if it is closed."""
    log, closed = [], False
    while not closed and turn in waiting:
        _, raw, valid, is_tool, tool, there, refused, satisfied_by = waiting.pop(turn)
        event = accepted = None
        if not valid:
            event = "invalid_json"
        elif is_tool:
            if len(called) >= budget:
                event, closed = "budget_exhausted", True
            elif tool in called:
                event = "duplicate_tool"
            else:
                event = "ok" if there else "unavailable"
                called = [*called, tool]
                observed = [*observed, tool] if there else observed
        elif refused and not set(satisfied_by) & set(observed):
            event = "rejected"
        else:
            accepted = closed = True
        turn += 1
        closed = bool(closed) or turn >= budget + 2
        log.append((turn - 1, event, tool, bool(accepted), closed, called, observed, raw))
    return log, None if closed else [turn, called, observed, [*waiting.values()]]


def _loop(budget: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """One bucket of cases: outputs of each in the order of their turns, until it is closed; of a closed case only its id is kept."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, past = json.loads(state.get[0]) if state.exists else ([], [])
        done, cases, touched = dict.fromkeys(closed), {case: kept for case, *kept in past}, {}
        for frame in frames:
            for case, *row in (json.loads(text).values() for text in frame["output"]):
                if case in done:
                    continue
                if case not in touched:
                    turn, called, observed, early = cases.get(case, (0, [], [], []))
                    touched[case] = turn, called, observed, {at[0]: at for at in early}
                if row[0] >= touched[case][0]:
                    touched[case][3].setdefault(row[0], row)
        log = []
        for case, known in touched.items():
            told, kept = _played(*known, budget)
            log += [(case, *row) for row in told]
            if kept is None:
                done[case] = cases.pop(case, None)
            else:
                cases[case] = kept
        if touched:
            state.update((json.dumps([list(done), [(case, *kept) for case, kept in cases.items()]]),))
        if log:
            yield pd.DataFrame(log, columns=[c.split(" ")[0] for c in LOG.split(", ")])

    return work


def turn_log(outputs: DataFrame, budget: int = 4) -> DataFrame:
    """The log of turns (see LOG) of a stream of outputs; a case is closed by a decision, by its last turn or by its budget."""
    rows = understood(outputs).filter((F.col("turn") >= 0) & (F.col("turn") < budget + 2))
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(_BUCKETS)).alias("bucket")
    dealt = rows.select(bucket, F.to_json(F.struct("case_id", *_READ), {"ignoreNullFields": "false"}).alias("output"))
    return dealt.groupBy("bucket").applyInPandasWithState(_loop(budget), LOG, "told string", "append", "NoTimeout")


def loop_session(spark: SparkSession) -> SparkSession:
    """A session of its own for these queries, whose state store other queries need not share."""
    own = spark.newSession()
    store = "spark.sql.streaming.stateStore"
    own.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set(f"{store}.rocksdb.changelogCheckpointing.enabled", "true")  # a partition's commit writes its changes, not its files
    own.conf.set(f"{store}.rocksdb.boundedMemoryUsage", "true")  # of all partitions in an executor
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # each may bring a bucket's state
    return own


def run_turns(outputs: DataFrame, path: str, checkpoint: str, budget: int = 4) -> StreamingQuery:
    """Take all outputs (a stream of loop_session) that are there, append their turns to the log and stop; a restart goes on from there."""
    return run_available(turn_log(outputs, budget), path, checkpoint)


def decided(log: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions of all cases from a log: as agent.play gives them, with history, turns, called and observed."""
    none = F.array().cast("array<string>")
    last = F.max_by(F.struct("accepted", "raw", "called", "observed"), "turn").alias("l")
    events = F.transform(F.array_sort(F.collect_list(F.struct("turn", "event"))), lambda e: e["event"])
    told = log.groupBy("case_id").agg(last, F.array_compact(events).alias("history"), F.count("*").cast("int").alias("turns"), F.every(~F.col("event").eqNullSafe("invalid_json")).alias("parse_success"))
    told = told.select("case_id", F.col("l.accepted").alias("resolved"), "l.raw", "l.called", "l.observed", "history", "turns", "parse_success")
    rows = cases.drop("called", "observed").join(told, "case_id", "left").withColumns({k: F.coalesce(k, none) for k in ("called", "observed", "history")})
    rows = rows.withColumns({"resolved": F.coalesce("resolved", F.lit(False)), "turns": F.coalesce("turns", F.lit(0)), "parse_success": F.coalesce("parse_success", F.lit(True))})
    rows = rows.withColumns({f"raw_{k}": v for k, v in ((k.removeprefix("raw_"), c) for k, c in agent.parsed(F.col("raw")).items() if k.startswith("raw_"))})
    rows = agent.allowed(gate.normalized(rows, "observed"))
    given = rows.filter("resolved")
    open_ = gate.fallback(rows.filter("NOT resolved").drop("action", "label", "repair"), "no decision").drop("unresolved")
    both = given.unionByName(open_, allowMissingColumns=True).drop("raw", "raw_action", "raw_label", "raw_repair")
    return both.withColumns({k: F.array_sort(F.array_distinct(k)) for k in ("called", "observed")})
