"""The streamed decision loop against the batch one."""

import random

from pyspark.sql import functions as F

from attestra.operators import agent
from attestra.plans import audit
from attestra.streaming import loop, stream

TOOLS = ["reparse_artifact", "profile_values", "get_dictionary_entry", "check_id_overlap", "check_lineage", "check_imaging_order", "escalate_to_human"]
COLUMNS = ["case_id", "action", "label", "repair", "resolved", "called", "observed", "history", "turns", "parse_success"]


def outputs(rng):
    tool = lambda: f'{{"tool": "{rng.choice(TOOLS)}"}}'
    offer = lambda: f'{{"action": "{rng.choice(["recover", "accept_provisionally", "abstain", "escalate", "other"])}", "label": "{rng.choice(["diagnosis", "mixed", "panss_item"])}", "repair": {{"x": 1}}}}'
    return [rng.choice([tool, tool, tool, offer, lambda: "prose", lambda: None])() for _ in range(6)]


def test_a_restarted_stream_gives_the_decisions_of_the_batch_loop(spark, sf, tmp_path):
    rng = random.Random(11)
    cases = audit.typed_cases(spark, sf).withColumn("tools", F.array(*map(F.lit, TOOLS[:6])))
    ids = sorted(r["case_id"] for r in cases.select("case_id").collect())
    scripts = spark.createDataFrame([(i, outputs(rng)) for i in ids], "case_id string, script array<string>")
    scripted = cases.join(scripts, "case_id")
    scripted.write.parquet(str(tmp_path / "cases"))
    scripted = spark.read.parquet(str(tmp_path / "cases"))
    want = sorted(tuple(r) for r in agent.play(scripted, agent.scripted()).select(COLUMNS).collect())
    turns = scripted.select("*", F.posexplode("script").alias("turn", "raw")).drop("script")
    inbox, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    deal = F.pmod(F.xxhash64("case_id", "turn"), F.lit(3))
    for k in range(4):  # in any order, and a third of them a second time
        turns.filter((deal == k) | ((deal == 0) & (k == 3))).write.mode("append").parquet(inbox)
        loop.run_turns(loop.loop_session(spark).readStream.schema(turns.schema).parquet(inbox), log, check)
        found = spark.read.schema(loop.LOG).parquet(log)
        assert found.count() == found.select("case_id", "turn").distinct().count()
    got = sorted(tuple(r) for r in loop.decided(found, scripted.drop("script")).select(COLUMNS).collect())
    assert got == want
    assert {e for r in want for e in r[7]} == {"rejected", "ok", "unavailable", "duplicate_tool", "invalid_json", "budget_exhausted"}
    # nothing new, nothing again
    loop.run_turns(loop.loop_session(spark).readStream.schema(turns.schema).parquet(inbox), log, check)
    assert spark.read.schema(loop.LOG).parquet(log).count() == found.count()


def test_cases_share_states_and_calls(spark, sf, tmp_path, monkeypatch):
    """Three buckets: a state and a call hold many cases, and give each the turns that the batch loop gives it."""
    monkeypatch.setattr(loop, "_BUCKETS", 3, raising=False)
    rng = random.Random(5)
    cases = audit.typed_cases(spark, sf).withColumn("tools", F.array(*map(F.lit, TOOLS[:6])))
    ids = sorted(r["case_id"] for r in cases.select("case_id").collect())
    prose = 'said: "é\u2028\\n{\n\t'  # no object; what JSON has to escape
    scripts = spark.createDataFrame([(i, [prose, *outputs(rng)[1:]]) for i in ids], "case_id string, script array<string>")
    scripted = cases.join(scripts, "case_id")
    scripted.write.parquet(str(tmp_path / "cases"))
    scripted = spark.read.parquet(str(tmp_path / "cases"))
    turns = scripted.select("*", F.posexplode("script").alias("turn", "raw")).drop("script")
    astray = turns.filter("turn = 0").withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(6), F.lit(None).cast("int"))))
    inbox, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    seen = []
    for part in (turns.filter("turn = 2 OR turn >= 4").unionByName(astray), turns.filter("turn = 3 OR turn = 0"), turns):
        part.write.mode("append").parquet(inbox)
        seen.append(loop.run_turns(loop.loop_session(spark).readStream.schema(turns.schema).parquet(inbox), log, check).lastProgress)
    assert all(sum(o["numRowsTotal"] for o in p["stateOperators"]) == 3 for p in seen)
    found = spark.read.schema(loop.LOG).parquet(log)
    assert found.count() == found.select("case_id", "turn").distinct().count()
    assert {r["raw"] for r in found.filter("turn = 0").collect()} == {prose} and found.filter("turn = 0").count() == len(ids)
    got = sorted(tuple(r) for r in loop.decided(found, scripted.drop("script")).select(COLUMNS).collect())
    assert got == sorted(tuple(r) for r in agent.play(scripted, agent.scripted()).select(COLUMNS).collect())


def test_cases_without_outputs_fall_back(spark, sf):
    cases = audit.typed_cases(spark, sf)
    done = loop.decided(spark.createDataFrame([], loop.LOG), cases)
    assert done.count() == cases.count() and {r["action"] for r in done.select("action").distinct().collect()} == {"abstain", "escalate"}


def test_a_gated_stream_decides_as_the_batch(spark, sf, tmp_path):
    from attestra.operators import gate

    raw = audit.raw_decisions(spark, sf)
    raw.write.parquet(str(tmp_path / "in"))
    stream.run_available(stream.gated_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    shown = ["case_id", "violation", "authorized", "action", "label", "repair"]
    rows = lambda df: sorted(map(str, df.select(shown).collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(gate.gated(raw))
