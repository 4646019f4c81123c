"""Entity keys: overlaps, order, guarded lookups, exact covers, duplicates, lineage pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S


def overlap_cards(links: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """A row for each (name, left, left key, right, right key): counts of both keys' normalised, non-empty values.

    The keys of all cards are counted in one pass, by card and key, so that a hot key is one row before anything is
    compared, and there is one shuffle for all cards together.
    """
    sides = []
    for name, left, left_key, right, right_key in links:
        for df, key, is_left in ((left, left_key, True), (right, right_key, False)):
            sides.append(df.select(F.lit(name).alias("card"), S.normalized_identifier(key).alias("k"), F.lit(int(is_left)).alias("l"), F.lit(int(not is_left)).alias("r")))
    each = reduce(DataFrame.unionByName, sides).groupBy("card", "k").agg(F.sum("l").alias("a"), F.sum("r").alias("b"))
    here, a, b = F.col("k") != "", F.col("a") > 0, F.col("b") > 0
    counted = each.groupBy("card").agg(
        F.sum("a").alias("left_n"),
        F.sum("b").alias("right_n"),
        F.count_if(here & a).alias("left_unique_n"),
        F.count_if(here & b).alias("right_unique_n"),
        F.count_if(here & a & b).alias("overlap_n"),
        F.coalesce(F.sum(F.when(here & a, F.col("a") - 1)), F.lit(0)).alias("duplicate_left_n"),
        F.coalesce(F.sum(F.when(here & b, F.col("b") - 1)), F.lit(0)).alias("duplicate_right_n"),
    )
    named = F.explode(F.array(*[F.lit(x[0]) for x in links])).alias("card")
    spark = links[0][1].sparkSession
    found = spark.range(1).select(named).join(counted, "card", "left").fillna(0)  # empty tables have a card too
    return found.withColumn("relationship", relationship())


def overlap_card(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """One row of counts of two key columns' normalised, non-empty values, and the relationship they make."""
    return overlap_cards([("", left, left_key, right, right_key)]).drop("card")


def relationship() -> Column:
    """Of a card's counts: partial, complete with repeats on the right, a proper subset, or one to one."""
    return S.first_match(
        [
            (F.col("overlap_n") < F.col("left_unique_n"), "partial_overlap"),
            (F.col("duplicate_right_n") > 0, "left_complete_with_right_duplicates"),
            (F.col("right_unique_n") > F.col("left_unique_n"), "left_complete_subset"),
        ],
        "one_to_one_technical_overlap",
    )


def order_agreement(left: DataFrame, right: DataFrame, pos: str, key: str) -> DataFrame:
    """Do two key columns agree position by position? Counts, mismatches, agreement."""
    a = left.select(F.col(pos).alias("p"), S.normalized_identifier(key).alias("a"))
    b = right.select(F.col(pos).alias("p"), S.normalized_identifier(key).alias("b"))
    both = a.join(b, "p", "full_outer")
    return both.agg(
        F.count("a").alias("left_n"), F.count("b").alias("right_n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatch_n")
    ).withColumn("order_agreement", F.col("mismatch_n") == 0)


def assert_same_order(left: DataFrame, right: DataFrame, pos: str, key: str) -> None:
    """Fail if the raw keys of two tables differ anywhere."""
    both = left.select(F.col(pos).alias("p"), F.col(key).alias("a")).join(right.select(F.col(pos).alias("p"), F.col(key).alias("b")), "p", "full_outer")
    if not both.filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
        raise ValueError(f"{key} is not in the same order")


def guarded_lookup(left: DataFrame, left_key: str, right: DataFrame, right_key: str, values: list[str]) -> DataFrame:
    """Left rows with the right row's values, but only where exactly one right row has the key.

    Adds source_status: matched_unique, duplicate_key or not_in_source. The right side is grouped by key
    before the join, so a repeated key is one row and takes no value.
    """
    found = (
        right.select(S.normalized_identifier(right_key).alias("__k"), F.struct(*values).alias("__v"))
        .filter("__k <> ''")
        .groupBy("__k")
        .agg(F.count("*").alias("__n"), F.first("__v").alias("__v"))
    )
    status = F.when(F.col("__n").isNull(), "not_in_source").when(F.col("__n") > 1, "duplicate_key").otherwise("matched_unique")
    joined = left.withColumn("__k", S.normalized_identifier(left_key)).join(found, "__k", "left")
    taken = [F.when(F.col("__n") == 1, F.col("__v")[v]).alias(f"source_{v}") for v in values]
    return joined.select(*[joined[c] for c in left.columns], status.alias("source_status"), *taken)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def cover(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, problem) with missing or unexpected."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def require_cover(expected: DataFrame, actual: DataFrame, key: str) -> None:
    """Fail, naming five keys, unless both sides hold the same keys once each."""
    for side, name in ((expected, "expected"), (actual, "actual")):
        if twice := duplicate_keys(side, key).limit(5).collect():
            raise ValueError(f"duplicate {key} in {name}: {[r[key] for r in twice]}")
    if wrong := cover(expected, actual, key).orderBy("problem", key).limit(5).collect():
        raise ValueError(f"{key}: {[(r['problem'], r[key]) for r in wrong]}")


def merge_shards(shards: DataFrame, oracle: DataFrame, key: str = "case_id", pos: str = "oracle_pos") -> DataFrame:
    """Shards' rows in the oracle's order; they must cover it exactly."""
    require_cover(oracle, shards, key)
    return shards.join(oracle.select(key, pos), key).orderBy(pos)


def inconsistent_metadata(public: DataFrame, oracle: DataFrame, fields: list[str], key: str = "case_id") -> DataFrame:
    """(key, field) wherever a public field differs from the oracle's."""
    a, b = public.select(key, F.struct(*fields).alias("a")), oracle.select(key, F.struct(*fields).alias("b"))
    wrong = F.explode(F.array_compact(F.array(*[F.when(~F.col("a")[f].eqNullSafe(F.col("b")[f]), F.lit(f)) for f in fields]))).alias("field")
    return a.join(b, key).select(key, wrong)


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join one to one; a key that repeats on either side is an error, found while the rows are read."""

    def once(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)))

    return once(left).join(once(right), key)


def lineage_pairs(df: DataFrame, family: str, member: str) -> DataFrame:
    """The two first members of each family that has two; never more than two ids are held for a family."""
    once = df.select(family, member).distinct()
    first = once.groupBy(family).agg(F.min(member).alias("left_member"), F.count("*").alias("members")).filter("members >= 2")
    rest = once.join(first.select(family, "left_member"), family).filter(F.col(member) > F.col("left_member"))
    second = rest.groupBy(family).agg(F.min(member).alias("right_member"))
    return first.join(second, family).select(family, "left_member", "right_member", "members")


def satisfied(required: Column, observed: Column) -> Column:
    """Is some required set of tools a subset of those observed? No sets: no; an empty set: yes."""
    return F.exists(required, lambda r: F.size(F.array_except(r, observed)) == 0)


def with_name(name: str, df: DataFrame, column: str = "system") -> DataFrame:
    """For vertical concatenation: the name of the part as first column."""
    return df.select(F.lit(name).alias(column), "*")


def row_counts(frames: dict[str, DataFrame], expected: dict[str, int] | DataFrame) -> DataFrame:
    """(name, expected_n, n, as_expected) of tables whose numbers of rows are known beforehand; expected: by name, or (name, expected_n)."""
    found = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])
    if isinstance(expected, dict):
        expected = found.sparkSession.createDataFrame(list(expected.items()), "name string, expected_n bigint")
    both = found.join(F.broadcast(expected), "name")  # a row for each table
    return both.select("name", "expected_n", "n", (F.col("n") == F.col("expected_n")).alias("as_expected"))


def require_row_counts(frames: dict[str, DataFrame], expected: dict[str, int]) -> None:
    """Fail if a table has not the number of rows that is expected of it."""
    wrong = row_counts(frames, expected).filter("NOT as_expected").first()
    if wrong:
        raise ValueError(f"expected {wrong['expected_n']} rows of {wrong['name']}, found {wrong['n']}")
