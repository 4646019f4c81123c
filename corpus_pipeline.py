"""A cleaned and tokenised corpus from raw documents, stage by stage.

Every stage takes any columns beside doc_id and text, whatever their names, and all but the last return them as
they were. A null text counts as empty and stays null; rows with a null id are rows like others; an empty table
gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import decontamination, jaccard, pii, sentencepiece, toxicity
from attestra.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH = 4 << 20


def small_batches(stage: Stage) -> Stage:
    """Rows go to Python workers by about BATCH bytes and not by up to 64 MB at once, which JVM and worker both hold.

    A stage is planned when its result is written, so that this stays set in the session; no result depends on it.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the cut go. Empty texts have the score of no evidence; without labels all stay."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@small_batches
def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more, that of the least id stays.

    Empty and null texts are copies of each other; of rows that share id and text one stays.
    """
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Without items all stay."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced in the texts; n_chars follows. Null texts stay null."""
    return pii.redacted(docs)


@small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of each document; empty and null texts have no ids."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_a_kind),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("SentencePiece encoding and decoding", tokenize),
]

#: No SQL states the stages' models; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
