"""How metadata corruption reaches features: effects, adjusted coefficients, AUC, and their comparison.

Cohorts are rows of pos, features (array of doubles), diagnosis (1 or 2), age, sex (1 or 2) and site;
scenarios are told apart by the columns of `by`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..session import materialize
from . import ranks
from .crossval import cross_validated
from .panel import chosen_rows, rotate

TOP = 50
#: Sites of an adjusted model at most: each is a column of its design.
SITES = 64


def valid(cohort: DataFrame) -> DataFrame:
    """One row: how many rows have a bad vector, diagnosis or sex; and whether all vectors are of one length."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = lambda c: ~F.coalesce(F.col(c).isin(1, 2), F.lit(False))
    return cohort.agg(
        F.count_if(bad).alias("bad_vectors"), F.count_if(code("diagnosis")).alias("bad_diagnosis"), F.count_if(code("sex")).alias("bad_sex"),
        (F.min(F.size("features")) == F.max(F.size("features"))).alias("one_length"),
    )


#: Headers of the scores that a cohort takes, as (name, or what it begins with). Fixed values.
HEADERS = {"diagnosis": "diagnosis(", "age": "age", "sex": "gender(1:male; 2:female)", "site": "Site"}


def load_cohort(matrices: DataFrame, scores: DataFrame) -> DataFrame:
    """A cohort from matrices (pos, i, j, value) and scores (pos, fields, values: two arrays of one length).

    Features are the lower triangle of each matrix without its diagonal, in row order. A cohort without a site has site 1.
    Subjects on one side only, matrices that are not square and of one size, values that are no finite numbers and codes
    other than 1 and 2 are errors that show when rows are read.
    """
    size = matrices.groupBy("pos").agg(
        (F.max("i") + 1).alias("k"), F.max("j").alias("j"), F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("i") > F.col("j"), F.struct("i", "j", "value")))), lambda c: c["value"]).alias("features"),
    )
    most = F.broadcast(size.agg(F.max("k").alias("most")))  # one row
    size = size.crossJoin(most).withColumn("square", (F.col("j") == F.col("k") - 1) & (F.col("n") == F.col("k") * F.col("k")) & (F.col("k") == F.col("most")))
    header = {c: S.field_lookup(F.col("fields"), h, h) if c == "diagnosis" else F.when(F.array_contains("fields", h), F.lit(h)) for c, h in HEADERS.items()}
    at = lambda c: F.get("values", (F.array_position("fields", header[c]) - 1).cast("int"))
    told = scores.select(F.col("pos").alias("p"), *[at(c).cast("double").alias(c) for c in ("diagnosis", "age", "sex")], F.when(header["site"].isNull(), F.lit(1.0)).otherwise(at("site").cast("double")).alias("site"))
    both = size.join(told, F.col("pos") == F.col("p"), "full")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    code = lambda c: F.coalesce(F.col(c).isin(1.0, 2.0), F.lit(False))
    wrong = (
        F.when(F.col("pos").isNull() | F.col("p").isNull(), "feature and score rows differ").when(~F.col("square"), "matrices are not square and of one size")
        .when(~F.forall("features", fine), "features contain non-finite values").when(~code("diagnosis"), "diagnosis is neither 1 nor 2").when(~code("sex"), "sex is neither 1 nor 2")
        .when(~fine(F.col("age")) | ~fine(F.col("site")), "age or site is no finite number")
    )
    checked = F.when(wrong.isNull(), F.col("pos")).otherwise(F.raise_error(wrong).cast(matrices.schema["pos"].dataType))
    return both.select(checked.alias("pos"), "features", *[F.col(c).cast("int").alias(c) if c in ("diagnosis", "sex") else c for c in ("diagnosis", "age", "sex", "site")])


def long(cohort: DataFrame, *keep: str) -> DataFrame:
    return cohort.select(*keep, F.posexplode("features").alias("feature", "x"))


def smd(cohort: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, effect): mean difference of the classes over their pooled deviation, 0 where that is 0."""
    rows = long(cohort.withColumn("y", F.coalesce((F.col("diagnosis") == 1).cast("int"), F.lit(0))), *by, "y")
    x1, x0 = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    got = rows.groupBy(*by, "feature").agg(
        F.count(x1).alias("n1"), F.count(x0).alias("n0"), F.avg(x1).alias("m1"), F.avg(x0).alias("m0"), F.var_samp(x1).alias("v1"), F.var_samp(x0).alias("v0")
    )
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return got.select(*by, "feature", F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("effect"))


def auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, auc) of rows y (1 or 0) and x, ties counted half.

    Equal scores are counted together; what lies below a score is a running count over ranges of scores of about equal
    size, so that no window holds more than one range, however the scores are spread.
    """
    by = list(by)
    tied = ranks.placed(scores.groupBy(*by, "x").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")), ["x"], by)
    ranked = ranks.before(tied, ["x"], F.col("q"), by)
    wins = F.sum(F.col("p") * (F.col("before") + F.col("q") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(wins, F.sum("p") * F.sum("q")).alias("auc"))


def compare(clean: DataFrame, altered: DataFrame, by: Sequence[str] = (), top: int = TOP) -> DataFrame:
    """(by, correlation, rmse, sign_flip_rate, top_k_jaccard) of two effect vectors (feature, effect)."""
    keys = list(by) or ["__all"]
    both = altered.withColumnRenamed("effect", "b").join(clean.select("feature", F.col("effect").alias("a")), "feature")
    both = both.select(*[F.lit(0).alias("__all")] * (not by), *by, "feature", "a", "b")
    either = (F.abs("a") > 1e-12) | (F.abs("b") > 1e-12)
    found = both.groupBy(*keys).agg(
        F.corr("a", "b").alias("correlation"),
        F.sqrt(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("rmse"),
        F.avg(F.when(either, (F.signum("a") != F.signum("b")).cast("int"))).alias("sign_flip_rate"),
    )

    def largest(c: str) -> DataFrame:
        # tasks keep only so many rows of a scenario before they meet
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(c).desc(), "feature"))
        return both.select(*keys, "feature", rank.alias("rank")).filter(F.col("rank") <= top).drop("rank")

    marked = largest("a").unionByName(largest("b")).groupBy(*keys, "feature").agg(F.count("*").alias("n"))
    shared = marked.groupBy(*keys).agg((F.count_if(F.col("n") == 2) / F.count("*")).alias("top_k_jaccard"))
    return found.join(shared, keys).drop("__all")


def adjusted_coefficient(cohort: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, coefficient) of the diagnosis in a linear model with age, sex and site, for each group of by.

    Spark sums the moments of the design and of design times feature; a task gets the moments of one group, a few
    numbers for each feature, and solves them with the pseudo-inverse, as sites may be collinear. The sites' list
    is a row of distinct values, SITES at most.
    """
    by = list(by)
    sites = sorted(r[0] for r in cohort.select("site").filter("site IS NOT NULL").distinct().limit(SITES + 1).collect())
    if len(sites) > SITES:
        raise ValueError(f"more than {SITES} sites")
    keys = [F.col(c) for c in by] or [F.lit(0).alias("__all")]
    names = by or ["__all"]
    rows = cohort.select(*keys, "diagnosis", "age", "sex", "site", "features")
    moments = rows.groupBy(*names).agg(F.avg("age").alias("ma"), F.stddev_pop("age").alias("sa"), F.avg("sex").alias("ms"), F.stddev_pop("sex").alias("ss"))
    z = lambda c, m, d: F.coalesce(F.try_divide(F.col(c) - F.col(m), F.when(F.col(d) > 0, F.col(d))), F.lit(0.0))
    base = [F.lit(1.0), F.coalesce((F.col("diagnosis") == 1).cast("double"), F.lit(0.0)), z("age", "ma", "sa"), z("sex", "ms", "ss")]
    # sites are columns of ones and zeros: sums by site are all their products with the others
    k, place = len(base), F.coalesce(*[F.when(F.col("site") == v, i) for i, v in enumerate(sites[1:], 1)], F.lit(0))
    rows = rows.join(F.broadcast(moments), names).select(*names, "features", F.array(*base).alias("d"), place.cast("int").alias("place"))
    products = F.array(*[F.get("d", F.lit(i)) * F.get("d", F.lit(j)) for i in range(k) for j in range(k)])
    gram = rows.select(*names, "place", products.alias("p")).groupBy(*names, "place").agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(k * k)]).alias("g"))
    gram = gram.groupBy(*names).agg(F.collect_list(F.struct("place", "g")).alias("gram"))
    cross = rows.select(*names, "place", "d", F.posexplode("features").alias("feature", "x")).groupBy(*names, "feature", "place")
    cross = cross.agg(F.array(*[F.sum(F.get("d", F.lit(i)) * F.col("x")) for i in range(k)]).alias("c"))
    cross = cross.groupBy(*names, "feature").agg(F.collect_list(F.struct("place", "c")).alias("cross")).join(F.broadcast(gram), names)
    q = k + max(0, len(sites) - 1)

    def solve(group):
        whole = np.zeros((q, q))
        for part in group["gram"].iloc[0]:
            own, at = np.reshape(part["g"], (k, k)), k + part["place"] - 1
            whole[:k, :k] += own
            if part["place"]:
                whole[at, :k] = whole[:k, at] = own[0]
                whole[at, at] = own[0, 0]
        right = np.zeros((len(group), q))
        for row, parts in enumerate(group["cross"]):
            for part in parts:
                right[row, :k] += part["c"]
                if part["place"]:
                    right[row, k + part["place"] - 1] = part["c"][0]
        return group[[*names, "feature"]].assign(coefficient=right @ np.linalg.pinv(whole)[1])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", feature int, coefficient double"
    return cross.groupBy(*names).applyInPandas(solve, schema).select(*by, "feature", "coefficient")


def label_inversion(cohort: DataFrame, by: Sequence[str], seed: str = "seed", rate: str = "rate") -> DataFrame:
    """Chosen rows get the other diagnosis."""
    rows = chosen_rows(cohort, "pos", by, seed, rate)
    return rows.withColumn("new_diagnosis", F.when(F.col("chosen"), 3 - F.col("diagnosis")).otherwise(F.col("diagnosis")))


def row_order(cohort: DataFrame, by: Sequence[str], seed: str = "seed", rate: str = "rate") -> DataFrame:
    """Chosen rows take diagnosis, age, sex and site of the chosen row before them, all four together."""
    return rotate(chosen_rows(cohort, "pos", by, seed, rate), "pos", ["diagnosis", "age", "sex", "site"], by, forward=False)


def inverted(c: str) -> Column:
    return 3 - F.col(c)


METRICS = ("correlation", "rmse", "sign_flip_rate", "top_k_jaccard")


def sensitivity(cohort: DataFrame, grid: Sequence[tuple[float, int]], aucs: bool = False) -> DataFrame:
    """(family, rate, seed, n, changed_n, comparisons) for both corruptions and both null controls.

    Compared with the clean cohort are the effects and, as adjusted_<metric>, the coefficients adjusted for age, sex
    and site. With aucs come clean_auc, altered_auc and auc_delta, cross-validated anew for each cell of the grid.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(s).alias("seed")) for r, s in grid])).alias("c")
    by, covariates = ["rate", "seed"], ("diagnosis", "age", "sex", "site")
    # scenarios differ in what is told of a subject; the features stay one table
    features, told = cohort.select("pos", "features"), cohort.select("pos", *covariates)
    rows = told.select("*", cells).select(*told.columns, "c.rate", "c.seed")
    turned = label_inversion(rows, by)
    turned = turned.select(F.lit("diagnosis_inversion").alias("family"), *by, "pos", F.col("new_diagnosis").alias("diagnosis"), "age", "sex", "site", F.col("chosen").cast("int").alias("changed"))
    shifted = F.coalesce((F.col("chosen") & (F.col("k") > 1)), F.lit(False)).cast("int").alias("changed")
    moved = row_order(rows, by).select(F.lit("row_order").alias("family"), *by, "pos", *[F.col(f"new_{c}").alias(c) for c in covariates], shifted)
    seeds = sorted({s for _, s in grid})
    every_seed = told.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).withColumn("rate", F.lit(1.0))

    def control(family: str, **changed: Column) -> DataFrame:
        return every_seed.select(F.lit(family).alias("family"), *by, "pos", *[changed.get(c, F.col(c)).alias(c) for c in covariates], F.lit(1).alias("changed"))

    every = turned.unionByName(moved)
    every = every.unionByName(control("global_diagnosis_inversion_control", diagnosis=inverted("diagnosis")))
    every = every.unionByName(control("global_sex_recode_control", sex=inverted("sex")))
    keys = ["family", *by]
    every = materialize(every, "sensitivity-scenarios")
    sizes = every.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("changed").alias("changed_n"))
    full = every.join(features, "pos")
    effect = compare(smd(cohort), smd(full, keys), keys)
    adjusted = lambda df, k: adjusted_coefficient(df, k).withColumnRenamed("coefficient", "effect")
    other = compare(adjusted(cohort, []), adjusted(full, keys), keys)
    other = other.select(*keys, *[F.col(m).alias(f"adjusted_{m}") for m in METRICS])
    found = sizes.join(effect, keys).join(other, keys)
    if not aucs:
        return found
    # each part is written, so that the driver never holds the plan of the whole grid at once
    found = materialize(found, "sensitivity-effects")
    # the clean cohort is a family of its own; all models of all cells are fitted together, a recoded sex is in none
    untouched = control("clean")
    wanted = every.filter(F.col("family") != "global_sex_recode_control").unionByName(untouched).select(*keys, "pos", "diagnosis")
    probabilities = materialize(cross_validated(wanted, F.col("seed"), keys, features=features), "sensitivity-probabilities")
    scored = materialize(auc(probabilities, keys), "sensitivity-aucs")
    clean = scored.filter("family = 'clean'").select("seed", F.col("auc").alias("clean_auc"))
    altered = scored.filter("family != 'clean'").withColumnRenamed("auc", "altered_auc")
    found = found.join(F.broadcast(clean), "seed").join(F.broadcast(altered), keys, "left")
    # a recoded sex is no feature of the classifier
    found = found.withColumn("altered_auc", F.coalesce("altered_auc", F.when(F.col("family") == "global_sex_recode_control", F.col("clean_auc"))))
    return found.withColumn("auc_delta", F.col("altered_auc") - F.col("clean_auc"))


def summarize(replicates: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, least and greatest of each metric by family and rate; null keys make groups."""
    each = [f(F.col(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return replicates.groupBy(*keys).agg(F.count("*").alias("replicates"), *each)


def downstream_report(summary: DataFrame) -> DataFrame:
    """One row of what a summary of replicates with AUCs says: the clean AUC, the losses at half the rows, the controls.

    row_order_fraction_of_gap is the share of the clean AUC's distance from one half that row order takes away.
    """
    at = lambda family, rate, c: F.max(F.when((F.col("family") == family) & (F.col("rate") == rate), F.col(c)))
    loss, clean = F.abs(at("row_order", 0.5, "auc_delta_mean")), at("row_order", 0.0, "altered_auc_mean")
    return summary.agg(
        clean.alias("clean_auc"), (-loss).alias("row_order_50_delta"), F.try_divide(loss, clean - 0.5).alias("row_order_fraction_of_gap"), at("diagnosis_inversion", 0.5, "auc_delta_mean").alias("diagnosis_flip_50_delta"),
        *[at(f, 1.0, "auc_delta_mean").alias(f) for f in ("global_diagnosis_inversion_control", "global_sex_recode_control")],
    )


def evaluate_bundle(labelled: DataFrame, reference: DataFrame, seed: int = 101, least: int = 10) -> DataFrame:
    """evaluate_labels, and auc: cross-validated over the labelled rows, if `least` or more of both classes are."""
    found = evaluate_labels(labelled, reference)
    rows = reference.drop("diagnosis").join(labelled.select("pos", "diagnosis").filter(F.col("diagnosis").isin(1, 2)), "pos")
    sizes = {r["diagnosis"]: r["count"] for r in rows.groupBy("diagnosis").count().collect()}
    if len(sizes) < 2 or sum(sizes.values()) < least:
        return found.withColumn("auc", F.lit(None).cast("double"))
    return found.crossJoin(F.broadcast(auc(cross_validated(rows, F.lit(seed)))))


def evaluate_labels(labelled: DataFrame, reference: DataFrame) -> DataFrame:
    """Coverage of labels (pos, diagnosis) and their agreement with a reference, by position."""
    both = reference.select("pos", F.col("diagnosis").alias("r")).join(labelled.select("pos", "diagnosis"), "pos", "left")
    usable = F.col("diagnosis").isin(1, 2)
    return both.agg(
        F.count("*").alias("n"), F.count_if(usable).alias("labelled_n"), F.avg(F.coalesce(usable, F.lit(False)).cast("int")).alias("coverage"),
        F.count_if(usable & (F.col("diagnosis") == F.col("r"))).alias("agree_n"), F.count_if(usable & (F.col("diagnosis") == 1)).alias("class_1"), F.count_if(usable & (F.col("diagnosis") == 2)).alias("class_2"),
    )
