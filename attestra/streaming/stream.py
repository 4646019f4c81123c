"""The gate on streams: counts per window with a watermark, decisions as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gate


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str = "1 day", late: str = "1 hour", refused: Column | None = None) -> DataFrame:
    """(window_start, by, n, refused_n) of tumbling windows; rows later than the watermark are dropped."""
    rows = events.withWatermark(time, late)
    bad = refused if refused is not None else F.lit(False)
    got = rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("refused_n"))
    return got.select(F.col("window.start").alias("window_start"), *by, "n", "refused_n")


def gated_stream(cases: DataFrame) -> DataFrame:
    """Gate decisions of a stream of cases: narrow, so it is the same expression as in batch."""
    return gate.gated(cases)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now to parquet and stop; a restart goes on from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
