"""Ranks of any distribution, quartiles, trees of digests and models fitted together, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import crossval, effects, profile, ranks
from attestra.plans import cohorts


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables in as many ranges as large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_one_outlier_leaves_ranges_of_equal_size(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x")).union(spark.sql("SELECT 1e300D"))
    placed = ranks.placed(rows, ["x"])
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = ranks.before(placed, ["x"]).orderBy("x").collect()
    assert [r["before"] for r in got] == list(range(20_001)) and got[-1]["x"] == 1e300


def test_weights_groups_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]), rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, w int").groupBy("g", "x").agg(F.sum("w").alias("w"))
    for r in ranks.before(ranks.placed(df, ["x"], ["g"]), ["x"], F.col("w"), ["g"]).collect():
        key = lambda x: -1 if x is None else x
        assert r["before"] == sum(w for g, x, w in rows if g == r["g"] and key(x) < key(r["x"]))
    assert ranks.before(ranks.placed(df.limit(0), ["x"]), ["x"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 997])
def test_quartiles_by_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, 1e300, -5.5, rng.random(), float(rng.randrange(9))]) for _ in range(n)]
    same = [3.5] * n
    df = spark.createDataFrame(list(zip(values, same, [*map(str, values)], strict=True)), "x double, y double, t string")
    got = {r["column_name"]: r for r in profile.numeric(df, ["x", "y", "t"]).collect()}
    want = np.quantile(values, [0.25, 0.5, 0.75])
    for c in ("x", "t"):
        assert np.allclose([got[c]["q25"], got[c]["median"], got[c]["q75"]], want, rtol=1e-12)
    assert [got["y"][c] for c in ("q25", "median", "q75")] == [3.5] * 3


def root(values, fan):
    """values: (order, text) in any order."""
    runs = {}
    for v in values:
        runs[v] = runs.get(v, 0) + 1
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [digest(f"{v}\t{n}") for (_, v), n in sorted(runs.items())]
    while len(level) > 1:
        level = [digest("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0] if level else digest("")


@pytest.mark.parametrize(("n", "fan"), [(0, 3), (1, 3), (3, 3), (4, 3), (200, 3), (200, 256)])
def test_fingerprints_are_roots_of_trees(spark, n, fan):
    rng = random.Random(n)
    rows = [(rng.randrange(1 + n // 3), rng.choice([None, " a ", "b", "c"]), "same") for _ in range(n)]
    df = spark.createDataFrame(rows, "at int, v string, w string")
    got = {r["column_name"]: r["fingerprint"] for r in profile.fingerprints(df, ["v", "w"], "at", fan).collect()}
    for c, k in (("v", 1), ("w", 2)):
        tree = root([(r[0], "<NA>" if r[k] is None else r[k].strip()) for r in rows], fan)
        assert got[c] == hashlib.sha256(f"{c}\n{tree}".encode()).hexdigest()[:24]
    if n > 1:
        moved = df.withColumn("v", F.when(F.col("at") == rows[0][0], "other").otherwise(F.col("v")))
        assert profile.fingerprint(moved, "v", "at", fan).first()["fingerprint"] != got["v"]
        assert profile.fingerprint(df.orderBy(F.desc("at")).repartition(3), "v", "at", fan).first()["fingerprint"] == got["v"]


def test_auc_with_ties_and_an_outlier(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice([1e300, -1e300, float(rng.randrange(30))]), rng.choice("pq")) for _ in range(600)]
    got = {r["g"]: r["auc"] for r in effects.auc(spark.createDataFrame(rows, "y int, x double, g string"), ["g"]).collect()}
    for g in "pq":
        pos, neg = ([x for y, x, h in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)), abs=1e-12)


def test_the_largest_effects_of_each_scenario(spark):
    rng = random.Random(8)
    clean = [(f, rng.gauss(0, 1)) for f in range(90)]
    other = [(s, f, rng.gauss(0, 1) if s else e) for s in (0, 1, 2) for f, e in clean]
    got = {r["s"]: r for r in effects.compare(spark.createDataFrame(clean, "feature int, effect double"), spark.createDataFrame(other, "s int, feature int, effect double"), ["s"], 10).collect()}
    best = lambda rows: {f for f, e in sorted(rows, key=lambda r: (-abs(r[1]), r[0]))[:10]}
    for s in (0, 1, 2):
        a, b = best(clean), best([(f, e) for k, f, e in other if k == s])
        assert got[s]["top_k_jaccard"] == pytest.approx(len(a & b) / len(a | b))
    assert got[0]["rmse"] == 0 and got[0]["sign_flip_rate"] == 0


def fitted(x, y, strength):
    """Weights of one model by plain gradient steps with a bound on the curvature, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c = strength * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    bound = np.eye(x.shape[1]) + (x * (c / 4)[:, None]).T @ x
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        step = np.linalg.solve(bound, w + (c * (1 / (1 + np.exp(-x @ w)) - y)) @ x)
        w -= step
        if np.abs(step).max() < 1e-13:
            break
    return w


def by_hand(rows, most, strength):
    out = {}
    for k in {r["fold"] for r in rows}:
        train, test = [r for r in rows if r["fold"] != k], [r for r in rows if r["fold"] == k]
        x, y = np.array([r["features"] for r in train]), np.array([r["y"] for r in train])
        mean, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1
        a, b = x[y == 1], x[y == 0]
        between = len(a) * (a.mean(0) - mean) ** 2 + len(b) * (b.mean(0) - mean) ** 2
        within = ((a - a.mean(0)) ** 2).sum(0) + ((b - b.mean(0)) ** 2).sum(0)
        f = np.where(within > 0, between * (len(x) - 2) / np.where(within > 0, within, 1), -1)
        kept = np.sort(np.argsort(f, kind="stable")[-most:])
        w = fitted(((x - mean) / scale)[:, kept], y, strength)
        z = ((np.array([r["features"] for r in test]) - mean) / scale)[:, kept] @ w[:-1] + w[-1]
        out |= {r["pos"]: 1 / (1 + np.exp(-v)) for r, v in zip(test, z, strict=True)}
    return out


@pytest.mark.parametrize(("most", "chunk", "meet"), [(200, 4096, 64), (9, 50, 2)])
def test_models_fitted_together_are_those_fitted_alone(spark, sf, monkeypatch, most, chunk, meet):
    """Two scenarios of five models each, in one or in many chunks, to 1e-6."""
    monkeypatch.setattr(crossval, "CHUNK", chunk)
    monkeypatch.setattr(crossval, "MEET", meet)
    c = cohorts.cohort(spark, sf)
    both = c.withColumn("s", F.lit("a")).unionByName(c.withColumn("s", F.lit("b")).withColumn("diagnosis", F.when(F.col("pos") % 3 == 0, 1).otherwise(2)))
    got = crossval.cross_validated(both, F.lit(101), ["s"], most=most).collect()
    assert len(got) == both.count() and {r["fold"] for r in got} == set(range(5))
    features = {(r["s"], r["pos"]): r["features"] for r in both.collect()}
    for s in "ab":
        rows = [{"pos": r["pos"], "y": r["y"], "fold": r["fold"], "features": features[s, r["pos"]]} for r in got if r["s"] == s]
        want = by_hand(rows, most, crossval.STRENGTH)
        assert max(abs(want[r["pos"]] - r["x"]) for r in got if r["s"] == s) < 1e-6
    sizes = {}
    for r in got:
        sizes.setdefault((r["s"], r["y"], r["fold"]), []).append(r)
    for s in "ab":
        for y in (0, 1):
            n = [len(sizes.get((s, y, k), [])) for k in range(5)]
            assert max(n) - min(n) <= 1


def test_an_empty_cohort_and_one_class(spark, sf):
    c = cohorts.cohort(spark, sf)
    assert crossval.cross_validated(c.limit(0), F.lit(1)).count() == 0
    one = crossval.cross_validated(c.filter("diagnosis = 2"), F.lit(1)).collect()
    assert one and all(0 <= r["x"] <= 0.5 for r in one)


def test_downstream_losses_by_brute_force(spark, sf):
    """The whole grid: AUCs of every cell are those of its models fitted alone, controls lose nothing."""
    c = cohorts.cohort(spark, sf)
    found = effects.sensitivity(c, [(0.0, 3), (0.5, 3)], aucs=True).collect()
    got = {(r["family"], r["rate"]): r for r in found}
    assert len(got) == len(found) == 6
    rows = {r["pos"]: r for r in c.collect()}
    told = crossval.cross_validated(c, F.lit(3)).collect()
    want = by_hand([{"pos": r["pos"], "y": r["y"], "fold": r["fold"], "features": rows[r["pos"]]["features"]} for r in told], 200, crossval.STRENGTH)
    pos, neg = ([want[r["pos"]] for r in told if r["y"] == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    for family in ("row_order", "diagnosis_inversion"):
        assert got[family, 0.0]["clean_auc"] == pytest.approx(auc, abs=1e-6) and got[family, 0.0]["auc_delta"] == pytest.approx(0, abs=1e-9)
    assert got["global_sex_recode_control", 1.0]["auc_delta"] == 0
    assert abs(got["global_diagnosis_inversion_control", 1.0]["auc_delta"]) < 0.02
    assert got["row_order", 0.5]["altered_auc"] != got["row_order", 0.0]["altered_auc"]
