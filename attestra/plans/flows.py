"""Queries on files, streams and the decision loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent, linkage, profile
from ..session import materialize, scratch, table
from ..sources import cards, files
from ..streaming import loop, stream
from . import audit
from .registry import query


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "customer")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv") + ".csv"
    files.write_csv(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_brand", "p_size"])
    return files.read_table(spark, path, schema="p_partkey bigint, p_name string, p_brand string, p_size int")


_FILES = {"customer": "csv", "part": "json", "supplier": "parquet"}
_ASKED = {"customer": ["c_name", "c_site"], "part": ["p_partkey"], "supplier": ["zz", "age"]}


@query(""" UNION ALL """.join(
    f"SELECT '{t}' AS artifact, (SELECT count(*) FROM {t}) AS rows, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) AS column_names, true AS parsed, '{missing}' AS missing"
    for t, missing in (("customer", "c_site"), ("part", ""), ("supplier", "age,zz"))
))
def file_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables as files of three kinds; the cards of all files are made in one job and summed by table."""
    folder = scratch(spark, "artifacts")
    for name, kind in _FILES.items():
        rows, path = table(spark, sf_dir, name), f"{folder}/{name}.{kind}"
        if kind == "csv":
            files.write_csv(rows, path)
        elif kind == "jsonl":
            rows.write.json(path)
        else:
            rows.write.parquet(path)
    found = cards.listed(spark, folder, "part-*").select("path", F.regexp_extract("path", r"/(\w+)\.[a-z]+/part-", 1).alias("name"))
    asked = F.create_map(*[x for n, c in _ASKED.items() for x in (F.lit(n), F.array(*map(F.lit, c)))])
    manifest = found.select("path", "name", F.concat_ws(":", "name", F.sha2("path", 256)).alias("artifact_id"), F.get(F.array(asked), F.lit(0))[F.col("name")].alias("selected_columns"))
    told = cards.file_cards(manifest)
    first = F.get("structure", F.lit(0))
    return told.groupBy(F.col("name").alias("artifact")).agg(
        F.sum(first["rows"]).alias("rows"), F.max(F.array_join(F.array_sort(first["column_names"]), ",")).alias("column_names"), F.every(F.col("parser_status") == "parsed").alias("parsed"), F.max(F.array_join("missing_requested_columns", ",")).alias("missing")
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM customer")
def source_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's row as a stored artifact with its hash beside it; since then some rows have changed and some are gone."""
    rows = table(spark, sf_dir, "customer")
    digest, key = F.sha2(F.concat_ws("|", *rows.columns), 256), F.col("c_custkey")
    stored = rows.select(key.cast("string").alias("artifact_id"), key.cast("string").alias("path"), digest.alias("sha256"))
    path = scratch(spark, "cards")
    stored.write.parquet(path)
    later = rows.withColumn("c_acctbal", F.when(key % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).filter(key % 11 != 0)
    now = later.select(key.cast("string").alias("path"), digest.alias("sha256"))
    return profile.integrity(spark.read.parquet(path), now).select(F.col("artifact_id").cast("bigint").alias("c_custkey"), "status")


@query("SELECT doc_id, doc_id % 8 AS shard_id FROM documents")
def merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as eight shards and merged again; they must cover the oracle exactly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("shard_id"))
    oracle = docs.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("oracle_pos"))
    path = scratch(spark, "shards")
    docs.withColumnRenamed("doc_id", "case_id").write.partitionBy("shard_id").parquet(path)
    return linkage.merge_shards(spark.read.parquet(path), oracle).select(F.col("case_id").alias("doc_id"), F.col("shard_id").cast("bigint").alias("shard_id"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, count(*) FILTER (value < 1) AS refused_n FROM events GROUP BY ALL")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in daily windows; one late and last row closes the last window."""
    source = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(source)
    inbox, out = scratch(spark, "events"), scratch(spark, "windows")
    batch.write.parquet(inbox)
    close = batch.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit("__close__").alias("event_type"))
    empty = batch.limit(0).unionByName(close, allowMissingColumns=True).select(batch.columns)
    empty.write.mode("append").parquet(inbox)
    events = spark.readStream.schema(batch.schema).parquet(inbox).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.windowed_counts(events, "ts", ["event_type"], refused=F.col("value") < 1)
    stream.run_available(counts, out, f"{out}-checkpoint")
    return spark.read.parquet(out).filter("event_type <> '__close__'").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


#: The turns of _scripted, one after another: an offer or prose, a tool twice, an offer, and nothing any more.
_TURNS = f"""WITH {audit.PANEL}, {audit.RULES},
told AS (SELECT *, CASE WHEN task = 'T-FILE' THEN 'abstain' WHEN n_chars % 2 = 0 THEN 'recover' ELSE 'accept_provisionally' END AS offered, task = 'T-FILE' AS free,
 (task = 'T-COL' AND k % 2 = 0) OR (task = 'T-VAL' AND k % 3 <> 0) AS there FROM r),
ends AS (SELECT *, n_chars % 5 <> 0 AND free AS at_once, n_chars % 5 = 0 AND free OR there AS later FROM told),
all_turns AS (SELECT *, at_once OR later AS taken, CASE WHEN at_once THEN [] ELSE list_concat([CASE WHEN n_chars % 5 = 0 THEN 'invalid_json' ELSE 'rejected' END, CASE WHEN there THEN 'ok' ELSE 'unavailable' END, 'duplicate_tool'],
 CASE WHEN later THEN [] ELSE ['rejected', 'invalid_json', 'invalid_json'] END) END AS events FROM ends)
SELECT case_id, task, CASE WHEN taken THEN offered WHEN task = 'T-GOV' THEN 'escalate' ELSE 'abstain' END AS action, CASE WHEN task IN ('T-VAL', 'T-ID', 'T-GOV') THEN rule_label WHEN taken AND task = 'T-COL' THEN 'diagnosis' END AS label,
 taken AS resolved, (CASE WHEN at_once THEN 1 WHEN later THEN 4 ELSE 6 END)::INTEGER AS turns, array_to_string(events, ',') AS history, (CASE WHEN there AND NOT at_once THEN 1 ELSE 0 END)::INTEGER AS observed_n FROM all_turns"""


def _scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with four raw outputs that documents' lengths choose: prose or a candidate, a tool, the tool again, a candidate."""
    cases = audit.typed_cases(spark, sf_dir)
    n = F.col("n_chars")
    tool = lambda t: F.lit(f'{{"type":"tool","tool_name":"{t}"}}')
    offer = F.concat(F.lit('Here it is: ```json\n{"candidate":{"action":"'), F.when(n % 2 == 0, "recover").otherwise("accept_provisionally"), F.lit('","label":"diagnosis","repair":null}}'))
    first = F.when(n % 5 == 0, F.lit("no json here")).otherwise(offer)
    need = F.when(F.col("task") == "T-FILE", tool("reparse_artifact")).when(F.col("task") == "T-VAL", tool("get_dictionary_entry")).when(F.col("task") == "T-GOV", tool("escalate_to_human")).otherwise(tool("profile_values"))
    return cases.withColumn("script", F.array(first, need, need, offer))


def _shown(done: DataFrame) -> DataFrame:
    return done.select("case_id", "task", "action", "label", "resolved", "turns", F.array_join("history", ",").alias("history"), F.size("observed").alias("observed_n"))


@query(_TURNS)
def agent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision loop over scripted outputs, turn by turn over all cases."""
    return _shown(agent.play(_scripted(spark, sf_dir), agent.scripted()))


@query(_TURNS)
def agent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outputs as a stream, later turns first and some of them twice; the query stops and goes on in between."""
    cases = materialize(_scripted(spark, sf_dir), "agent-cases")
    silence = F.array(F.lit(None).cast("string"))
    outputs = cases.select("*", F.posexplode(F.concat("script", silence, silence)).alias("turn", "raw")).drop("script")
    inbox, log = scratch(spark, "agent-outputs"), scratch(spark, "agent-log")
    for part in ("turn >= 2 OR turn = 1 AND n_chars % 2 = 0", "turn <= 1 OR turn = 3"):
        outputs.filter(part).write.mode("append").parquet(inbox)
        loop.run_turns(loop.loop_session(spark).readStream.schema(outputs.schema).parquet(inbox), log, f"{log}-checkpoint")
    return _shown(loop.decided(spark.read.schema(loop.LOG).parquet(log), cases))
