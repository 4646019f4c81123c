"""Paired contrasts: differences, cluster-robust intervals, the exact McNemar test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import paired


def contrast(left: DataFrame, right: DataFrame, metric: str, keep: list[str]) -> DataFrame:
    """right minus left of a metric, case by case; a case that occurs twice in an arm is an error."""
    a = left.select("case_id", *keep, F.col(metric).cast("double").alias("a"))
    b = right.select("case_id", F.col(metric).cast("double").alias("b"))
    return paired(a, b, "case_id").select("case_id", *keep, "a", "b", (F.col("b") - F.col("a")).alias("d"))


def cluster_scores(diffs: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, sum of differences)."""
    return diffs.groupBy(cluster).agg(F.count("*").alias("n"), F.sum("d").alias("total"))


def cluster_se(diffs: DataFrame, cluster: str) -> DataFrame:
    """One row: n, clusters, estimate, standard error with the factor g / (g - 1)."""
    sums = cluster_scores(diffs, cluster)
    whole = sums.agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"), F.count("*").alias("clusters"))
    mean = F.col("all_total") / F.col("all_n")
    score = F.col("total") - F.col("n") * mean
    joined = sums.join(F.broadcast(whole))  # one row of totals
    got = joined.groupBy("all_n", "clusters", mean.alias("estimate")).agg(F.sum(score * score).alias("ss"))
    g = F.col("clusters")
    return got.select(F.col("all_n").alias("n"), "clusters", "estimate", F.sqrt(F.try_divide(g, g - 1) * F.col("ss") / (F.col("all_n") * F.col("all_n"))).alias("se"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps further on."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    for k in range(8):
        series = series - F.ln(x + k)
    return series


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's method; steps beyond its end change nothing."""
    safe = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)
    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def turn(acc: Column, top: Column) -> Column:
        d, c = 1 / safe(1 + top * acc["d"]), safe(1 + top / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def step(acc: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(acc, F.when(i % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps)), start, step, lambda acc: acc["h"])


def t_upper(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t for t >= 0."""
    df = df.cast("double")
    a, b, x = df / 2, F.lit(0.5), df / (df + t * t)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
    low = front * _beta_fraction(a, b, x) / a
    high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return F.when(x >= 1, 0.5).otherwise(F.when(x < (a + 1) / (a + b + 2), low).otherwise(high) / 2)


def t_quantile(p: float, df: Column, most: float = 1e6, halvings: int = 80) -> Column:
    """The t that a share p >= 1/2 of Student's distribution lies below, by halving an interval; null without a degree of freedom."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(most).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below = t_upper(mid, df) > 1 - p
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(df >= 1, found)


def interval(found: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds df, ci_low and ci_high to rows with estimate, se and clusters: Student's t on clusters - 1 degrees of freedom."""
    df = F.col("clusters") - 1
    half = t_quantile(0.5 + level / 2, df) * F.col("se")
    return found.withColumns({"df": df, "ci_low": F.col("estimate") - half, "ci_high": F.col("estimate") + half})


def binomial_two_sided(left: Column, right: Column) -> Column:
    """Exact two-sided p of discordant counts, term by term in logarithms; 1 if there are none."""
    n, k = left + right, F.least(left, right)
    start = F.struct(F.lit(0.0).alias("sum"), (-n * math.log(2)).alias("log"))

    def step(acc: Column, i: Column) -> Column:
        term = F.exp(acc["log"])
        more = acc["log"] + F.ln((n - i).cast("double") / (i + 1).cast("double"))
        return F.struct((acc["sum"] + term).alias("sum"), F.when(n > i, more).otherwise(acc["log"]).alias("log"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """Discordant counts of a and b (1 or 0 each) and the exact p."""
    got = pairs.agg(F.count_if(F.col("a") > F.col("b")).alias("left_only"), F.count_if(F.col("a") < F.col("b")).alias("right_only"))
    return got.select("left_only", "right_only", binomial_two_sided(F.col("left_only"), F.col("right_only")).alias("p"))
