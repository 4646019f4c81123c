"""Dense positions without gathering a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, order: str, name: str = "pos", by: Sequence[str] = (), width: int = 1 << 16) -> DataFrame:
    """Rank of each row by an integer column, from 1, within each group of `by`; the order of ties is open.

    Rows are ranked within ranges of the column, and the ranges' sizes are summed before them: what one
    window holds is a range's rows, and the window over ranges holds one row for each.
    """
    by = list(by)
    ranged = df.withColumn("__r", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(*by, "__r").agg(F.count("*").alias("__n"))
    outer = sizes.withColumn("__o", F.floor(F.col("__r") / width))
    before = F.sum("__n").over(Window.partitionBy(*by, "__o").orderBy("__r")) - F.col("__n")
    whole = outer.groupBy(*by, "__o").agg(F.sum("__n").alias("__m"))
    top = Window.partitionBy(*by, F.lit(0)).orderBy("__o")
    ahead = whole.select(*by, "__o", (F.sum("__m").over(top) - F.col("__m")).alias("__a"))
    offset = outer.select(*by, "__r", "__o", before.alias("__b")).join(ahead, [*by, "__o"]).select(*by, "__r", (F.col("__a") + F.col("__b")).alias("__off"))
    own = F.row_number().over(Window.partitionBy(*by, "__r").orderBy(order))
    ranked = ranged.withColumn("__k", own).join(offset, [*by, "__r"])
    return ranked.withColumn(name, F.col("__off") + F.col("__k")).drop("__r", "__k", "__off")
