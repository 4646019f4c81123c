"""Running sums in the order of any columns, whatever their distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def placed(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with the number of their range of (by, order), as a written table.

    The ranges are cut at sampled splitters, so that each has about as many rows as any other, however the values are
    spread. Rows must differ in (by, order): equal ones are counted before.
    """
    return materialize(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranks")


def before(rows: DataFrame, order: Sequence[str], weight: Column | int = 1, by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Adds to placed rows the sum of weight over the rows of their group that come before them.

    Sums run within a range, and over the sums of whole ranges before it: windows hold one range's rows, or one row a range.
    """
    by, w = list(by), F.lit(weight)
    sizes = rows.groupBy(*by, "__range").agg(F.sum(w).alias("__w"))
    whole = Window.partitionBy(*by or [F.lit(0)]).orderBy("__range")
    ahead = sizes.select(*by, "__range", (F.sum("__w").over(whole) - F.col("__w")).alias("__ahead"))
    own = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__own", F.coalesce(F.sum(w).over(own), F.lit(0)))
    found = inside.join(ahead, [*by, "__range"])
    return found.withColumn(name, F.col("__ahead") + F.col("__own")).drop("__range", "__own", "__ahead")
