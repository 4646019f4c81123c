"""Cross-validated probabilities of many models at once.

A scenario is a value of the columns `by`; each has as many models as folds. All models of all scenarios take a
Newton step together: tasks sum a model's gradient and curvature over chunks of its rows, the sums meet by model, and
the step is solved there. What meets in one place are sums of a chunk, never rows.

Each model scales the features by its training rows, keeps the MOST_FEATURES of the largest F statistic (of equals the
later ones) and minimises |w|^2 / 2 + STRENGTH * sum of class weight * logistic loss, the intercept being one of the
weights. Scaling and F statistics come from means and variances by fold, feature and class, joined without loss of digits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .positions import positions

FOLDS, MOST_FEATURES, STRENGTH = 5, 200, 0.1
#: Rows of a chunk, and chunks' sums that meet in one place.
CHUNK, MEET = 4096, 64
#: A model is fitted when no weight moves by more; if it is not by then, an error says so.
STILL, MOST_STEPS = 1e-10, 60


def folds(cohort: DataFrame, seed: Column, by: Sequence[str] = (), n: int = FOLDS) -> DataFrame:
    """Adds y and fold: rows of each class by the rank of their hash, dealt in turn."""
    rows = cohort.withColumns({"y": F.coalesce((F.col("diagnosis") == 1).cast("int"), F.lit(0)), "__h": F.xxhash64("pos", seed)})
    return positions(rows, "__h", "fold_rank", [*by, "y"], 1 << 48).withColumn("fold", (F.col("fold_rank") % n).cast("int")).drop("__h", "fold_rank")


def selections(rows: DataFrame, by: Sequence[str], n: int = FOLDS, most: int = MOST_FEATURES) -> DataFrame:
    """(by, model, chosen, w1, w0): for each model feature, mean and scale of what it keeps, in the order of features, and its class weights."""
    by = list(by)
    each = rows.select(*by, "fold", "y", F.posexplode("features").alias("feature", "x"))
    moments = each.groupBy(*by, "fold", "feature", "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    moments = materialize(moments, "crossval-moments")
    parts = moments.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("model")).filter("model != fold")
    own = Window.partitionBy(*by, "model", "feature", "y")
    mean = F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own)
    parts = parts.withColumn("mean", mean).withColumn("ss", F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))))
    of = lambda y, c, f: F.coalesce(f(F.when(F.col("y") == y, F.col(c))), F.lit(0)).alias(f"{c}{y}")
    both = parts.groupBy(*by, "model", "feature").agg(*[of(y, c, f) for y in (0, 1) for c, f in (("n", F.sum), ("mean", F.max), ("ss", F.sum))])
    both = both.withColumn("all", F.col("n0") + F.col("n1")).withColumn("mean", (F.col("n0") * F.col("mean0") + F.col("n1") * F.col("mean1")) / F.col("all"))
    off = lambda y: F.col(f"n{y}") * (F.col(f"mean{y}") - F.col("mean")) * (F.col(f"mean{y}") - F.col("mean"))
    both = both.withColumn("between", off(0) + off(1)).withColumn("within", F.col("ss0") + F.col("ss1"))
    # a feature that is constant within the classes tells all or nothing
    f = F.when(F.col("within") > 0, F.col("between") * (F.col("all") - 2) / F.col("within")).when(F.col("between") > 0, F.lit(float("inf")))
    order = Window.partitionBy(*by, "model").orderBy(F.desc_nulls_last("f"), F.desc("feature"))
    kept = both.withColumn("f", f).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    deviation = F.sqrt((F.col("between") + F.col("within")) / F.col("all"))
    kept = kept.withColumn("scale", F.when(deviation > 0, deviation).otherwise(1.0))
    weight = lambda y: F.coalesce(F.try_divide(F.max("all"), 2 * F.max(f"n{y}")), F.lit(0.0)).alias(f"w{y}")
    return kept.groupBy(*by, "model").agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "scale"))).alias("chosen"), weight(1), weight(0))


def _design(features: np.ndarray, model) -> np.ndarray:
    at, mean, scale = (np.array([c[k] for c in model.chosen]) for k in ("feature", "mean", "scale"))
    return np.hstack([(features[:, at.astype(int)] - mean) / scale, np.ones((len(features), 1))])


def _sums(rows: pd.DataFrame, models: pd.DataFrame, names: list[str], strength: float) -> pd.DataFrame:
    """Loss, gradient and curvature of each model over a chunk of rows."""
    out = []
    if len(rows):
        features, y, fold = np.stack(rows["features"].to_numpy()), rows["y"].to_numpy(float), rows["fold"].to_numpy()
        for key, model in zip(models[names].itertuples(index=False, name=None), models.itertuples(index=False), strict=True):
            train = fold != model.model
            x, t = _design(features[train], model), y[train]
            z, c = x @ np.asarray(model.weights), strength * np.where(t == 1, model.w1, model.w0)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            curve = (x * (c * p * (1 - p))[:, None]).T @ x
            out.append([*key, model.model, model.chunk, float(c @ (np.logaddexp(0, z) - t * z)), (c * (p - t)) @ x, curve.ravel()])
    return pd.DataFrame(out, columns=[*names, "model", "chunk", "loss", "gradient", "curvature"])


def _met(group: pd.DataFrame) -> pd.DataFrame:
    """One row of sums for those of several chunks."""
    one = group.iloc[[0]].copy()
    one["loss"] = group["loss"].sum()
    for c in ("gradient", "curvature"):
        one[c] = [np.sum(np.stack(group[c].to_numpy()), axis=0)]
    return one


def _stepped(sums: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """A model after its step: Newton's, or half the way back if the last one went too far."""
    one = model.iloc[[0]].copy()
    if not len(sums):
        one["moved"] = 0.0
        return one
    total, row = _met(sums).iloc[0], one.iloc[0]
    weights = np.asarray(row["weights"], float)
    loss = total["loss"] + weights @ weights / 2
    if loss > row["loss"] + 1e-9 * abs(row["loss"]):
        new, old = (weights + np.asarray(row["last"])) / 2, np.asarray(row["last"])
        one["moved"] = float(np.abs(new - weights).max())
    else:
        q = len(weights)
        new, old = weights - np.linalg.solve(np.reshape(total["curvature"], (q, q)) + np.eye(q), total["gradient"] + weights), weights
        one["loss"], one["moved"] = loss, float(np.abs(new - weights).max())
    one["weights"], one["last"] = [new], [old]
    return one


def _told(rows: pd.DataFrame, models: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Probabilities of the rows that a model has not seen."""
    out = []
    if len(rows):
        features, fold = np.stack(rows["features"].to_numpy()), rows["fold"].to_numpy()
        for model in models.itertuples(index=False):
            test = fold == model.model
            z = _design(features[test], model) @ np.asarray(model.weights)
            out.append(rows.loc[test, [*names, "pos", "y", "fold"]].assign(x=1 / (1 + np.exp(-np.clip(z, -700, 700)))))
    return pd.concat(out) if out else pd.DataFrame(columns=[*names, "pos", "y", "fold", "x"])


def cross_validated(cohort: DataFrame, seed: Column, by: Sequence[str] = (), n: int = FOLDS, most: int = MOST_FEATURES, strength: float = STRENGTH, features: DataFrame | None = None) -> DataFrame:
    """(by, pos, y, fold, x): each row's probability of diagnosis 1 by the model of its scenario that has not seen its fold.

    Scenarios that share their features (pos, features) can give them once, beside a cohort without them.

    A scenario that lacks a class is fitted all the same. An empty cohort gives an empty result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cohort.schema}
    names = list(by) or ["all_rows"]
    keys = [F.col(c) for c in by] or [F.lit(0).alias("all_rows")]
    vector = F.transform("features", lambda x: x.cast("double")).alias("features")
    if features is None:
        rows = folds(cohort.select(*by, "pos", "diagnosis", vector), seed, by, n)
    else:
        rows = materialize(folds(cohort.select(*by, "pos", "diagnosis"), seed, by, n), "crossval-folds")
    sizes = rows.groupBy(*by).count().select(*keys, F.greatest(F.ceil(F.col("count") / CHUNK), F.lit(1)).cast("int").alias("chunks"))
    if features is not None:
        rows = rows.join(features.select("pos", vector), "pos")
    rows = rows.select(*keys, "pos", "y", "fold", "features").join(F.broadcast(sizes), names)  # a row for each scenario
    rows = materialize(rows.withColumn("chunk", F.pmod(F.xxhash64("pos", F.lit(3)), F.col("chunks")).cast("int")), "crossval-rows")
    zero = F.transform(F.concat("chosen", F.array(F.struct(F.lit(0).alias("feature"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale")))), lambda _: F.lit(0.0))
    state = materialize(selections(rows, names, n, most), "crossval-selections").select("*", zero.alias("weights"), zero.alias("last"), F.lit(1e300).alias("loss"), F.lit(1.0).alias("moved"))
    chunks = materialize(rows.select(*names, "chunks").distinct(), "crossval-chunks")
    state = materialize(state.join(F.broadcast(chunks), names), "crossval-models")
    most_chunks = chunks.agg(F.max("chunks")).first()[0] or 0
    kinds["all_rows"] = "int"
    named = ", ".join(f"{c} {kinds[c]}" for c in names)
    summed = f"{named}, model int, chunk int, loss double, gradient array<double>, curvature array<double>"
    for _ in range(MOST_STEPS):
        moving = state.filter(F.col("moved") > STILL)
        spread = moving.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        met = rows.groupBy(*names, "chunk").cogroup(spread.groupBy(*names, "chunk"))
        sums, left = met.applyInPandas(lambda a, b: _sums(a, b, names, strength), summed), most_chunks
        while left > MEET:
            sums = sums.withColumn("chunk", F.floor(F.col("chunk") / MEET).cast("int")).groupBy(*names, "model", "chunk").applyInPandas(_met, summed)
            left = -(-left // MEET)
        state = materialize(sums.groupBy(*names, "model").cogroup(state.groupBy(*names, "model")).applyInPandas(_stepped, state.schema), "crossval-models")
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= STILL:
            break
    else:
        raise RuntimeError(f"models still move after {MOST_STEPS} steps")
    spread = state.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    told = rows.groupBy(*names, "chunk").cogroup(spread.groupBy(*names, "chunk"))
    pos = dict(cohort.dtypes)["pos"]
    return told.applyInPandas(lambda a, b: _told(a, b, names), f"{named}, pos {pos}, y int, fold int, x double").drop(*set(names) - set(by))
