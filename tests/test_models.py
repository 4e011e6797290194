"""Models, calibration and paths against brute force."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def _pav(y, w):
    blocks = []
    for v, k in zip(y, w):
        blocks.append([v * k, k, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, k2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + k2, blocks[-1][2] + n]
    return np.repeat([t / k for t, k, _ in blocks], [n for *_, n in blocks])


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "late"])
def test_isotonic_equals_a_sequential_fit(spark, shape):
    """Also at a million points for noise, and where every partition's fit must be undone (falling) or none (rising)."""
    from tidemark.functions.interpolate import interpolate
    from tidemark.operators.calibration import isotonic_blocks

    n = 1_000_000 if shape == "noise" else 20_000
    i, big = F.col("id"), 1.0 * n
    noise = F.sin(i * 12.9898) * 43758.5453
    y = {"noise": i / big + noise - F.floor(noise), "rising": i / big, "falling": -i / big, "late": F.when(i < n - 50, i / big).otherwise(-5.0)}[shape]
    points = spark.range(n).select((F.col("id") % 1).alias("g"), (i / 1000.0).alias("x"), (y * (1 + i % 3)).alias("t"), (1 + i % 3).cast("double").alias("w"))
    points = points.union(points.where("id is not null").selectExpr("1L as g", "x", "t", "w").limit(100)) if shape == "falling" else points
    local = points.where("g = 0").toPandas().sort_values("x")
    want = _pav(local["t"] / local["w"], local["w"])
    blocks = isotonic_blocks(points.repartition(7), "g", "x", "t", "w").where("g = 0").toPandas().sort_values("low")
    got = blocks["value"].to_numpy()[np.searchsorted(blocks["low"], local["x"], side="right") - 1]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
    if shape in ("late", "falling"):
        nodes = spark.createDataFrame(pd.concat([blocks[["low", "value"]].rename(columns={"low": "x"}), blocks[["high", "value"]].rename(columns={"high": "x"})]).drop_duplicates("x")).withColumn("g", F.lit(0))
        asked = [-3.0, 0.0, 0.0005, 1.2345, 19.9, 19.999, 25.0]
        read = interpolate(spark.createDataFrame([(0, x) for x in asked], "g int, x double"), nodes, ["g"], "x", "value").toPandas().sort_values("x")
        np.testing.assert_allclose(read["value"], np.interp(asked, local["x"], want), rtol=1e-9, atol=1e-12)


def test_calibration_uses_earlier_folds_only(spark):
    from tidemark.operators.calibration import calibrate, calibration_table

    rng = np.random.default_rng(4)
    rows = [(date(2020, 1, 1) + timedelta(weeks=w), f"T{k}", w // 4, float(np.round(rng.normal(), 1)), None) for w in range(16) for k in range(40)]
    rows = [(d, t, f, p if i % 50 else None, None if i % 17 == 0 else 0.1 * (p or 0) + float(rng.normal())) for i, (d, t, f, p, _) in enumerate(rows)]
    rows.append((date(2020, 1, 1), "nan", 0, float("nan"), 1.0))
    df = spark.createDataFrame(rows, "decision_session date, ticker string, fold int, prediction double, label double")
    got = calibrate(df, min_rows=200).toPandas()
    assert len(got) == len(rows) and got[got.fold == 0]["expected_return"].isna().all()
    full = pd.DataFrame(rows, columns=["decision_session", "ticker", "fold", "prediction", "label"])
    for k in (2, 3):
        past = full[(full.fold < k)].dropna(subset=["prediction", "label"]).groupby("prediction")["label"].agg(["mean", "size"])
        fit = _pav(past["mean"], past["size"])
        mine = got[(got.fold == k) & got.prediction.notna()]
        np.testing.assert_allclose(mine["expected_return"], np.interp(mine["prediction"], past.index, fit), rtol=1e-9, atol=1e-12)
    few = calibration_table(df.withColumn("expected_return", F.col("prediction")).limit(30)).collect()
    assert len(few) == 1 and few[0].bucket is None and 0 < few[0].n <= 30
    assert calibration_table(calibrate(df, min_rows=10 ** 6)).collect()[0].n == 0
    assert calibrate(df.limit(0)).count() == 0


def test_ridge_of_all_folds_equals_closed_form(spark):
    from tidemark.operators.fold_ridge import coefficient_table, fit_folds, score_folds

    rng = np.random.default_rng(9)
    days = [date(2021, 1, 1) + timedelta(weeks=i) for i in range(30)]
    rows, folds = [], []
    for w, d in enumerate(days):
        for k in range(15):
            x = [float(v) if rng.random() > 0.2 else None for v in rng.normal(size=3)]
            rows.append((d, f"T{k}", *x, None if rng.random() < 0.1 else float(rng.normal() + 2 * (x[0] or 0)), float(rng.uniform(0.5, 2))))
            for f in range(3):
                role = "test" if w // 10 == f else "purged" if k % 7 == f and abs(w - 10 * f) < 12 else "train"
                folds.append((f, role, d, f"T{k}"))
            folds.append((3, "train" if w == 0 else "test", d, f"T{k}"))
    panel = spark.createDataFrame(rows, "decision_session date, ticker string, a double, b double, c double, label double, sample_weight double")
    table = spark.createDataFrame(folds, "fold int, role string, decision_session date, ticker string")
    fitted = fit_folds(panel, table, ["a", "b", "c"], alpha=3.0, min_labels=50)
    got = {r.fold: r for r in fitted.collect()}
    pdf = pd.DataFrame(rows, columns=["decision_session", "ticker", "a", "b", "c", "label", "w"])
    roles = pd.DataFrame(folds, columns=["fold", "role", "decision_session", "ticker"])
    for f in range(3):
        t = pdf.merge(roles[(roles.fold == f) & (roles.role == "train")], on=["decision_session", "ticker"]).dropna(subset=["label"])
        x = t[["a", "b", "c"]].astype(float)
        fills = x.median().to_numpy()
        z = x.fillna(x.median()).to_numpy()
        beta = np.linalg.solve(z.T @ (z * t[["w"]].to_numpy()) + 3 * np.eye(3), z.T @ (t["label"] * t["w"]).to_numpy())
        np.testing.assert_allclose(got[f].coefficients, beta, rtol=1e-9)
        np.testing.assert_allclose(got[f].fills, fills, rtol=1e-12)
        assert got[f].n == len(t)
    assert got[3].coefficients is None
    scored = score_folds(panel, table, fitted, ["a", "b", "c"]).toPandas()
    assert len(scored) == sum(r == "test" for _, r, *_ in folds) and scored[scored.fold == 3]["prediction"].isna().all()
    r = scored[scored.fold == 1].iloc[0]
    z = [got[1].fills[i] if pd.isna(r[c]) else r[c] for i, c in enumerate("abc")]
    assert abs(r["prediction"] - np.dot(z, got[1].coefficients)) < 1e-12
    assert coefficient_table(fitted, ["a", "b", "c"]).count() == 9


def _brute_boost(x, y, w, edges, trees, rate, leaves, depth, min_rows, penalty):
    """The same growth row by row: best-first splits over all features, edges and sides for what is missing."""
    score = np.full(len(y), (w * y).sum() / w.sum())
    losses = []
    for _ in range(trees):
        g = w * (y - score)

        def best(rows, g=g):
            found = None
            for f in range(x.shape[1]):
                for k, e in enumerate(edges[f]):
                    for missing_left in (True, False):
                        v = x[rows, f]
                        left = np.where(np.isnan(v), missing_left, v <= e)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < min_rows:
                            continue
                        s = lambda r: g[r].sum() ** 2 / (w[r].sum() + penalty)
                        gain = s(a) + s(b) - s(rows)
                        if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                            found = (gain, a, b)
            return found

        open_ = {1: np.arange(len(y))}
        while len(open_) < leaves:
            options = {n: b for n, r in open_.items() if n < 2 ** depth and (b := best(r)) is not None}
            if not options:
                break
            n = max(options, key=lambda n: (options[n][0], -n))
            _, open_[2 * n], open_[2 * n + 1] = options[n]
            del open_[n]
        for rows in open_.values():
            score[rows] += rate * g[rows].sum() / (w[rows].sum() + penalty)
        losses.append(float((w * (y - score) ** 2).sum() / w.sum()))
    return score, losses


def test_boosted_trees_equal_brute_force(spark):
    from tidemark.operators import boosting

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(240, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = np.where(np.nan_to_num(x[:, 0], nan=1.0) > 0, 1.0, -1.0) + 0.5 * np.nan_to_num(x[:, 1]) + rng.normal(0, 0.2, 240)
    w = rng.uniform(0.5, 2, 240)
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(a), float(b), i) for i, (r, a, b) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame([*rows, (1.0, 1.0, 1.0, None, 1.0, -1)], "a double, b double, c double, label double, sample_weight double, id int").repartition(3)
    options = {"trees": 4, "rate": 0.3, "leaves": 5, "depth": 3, "min_rows": 15, "penalty": 2.0}
    model = boosting.fit(df, ["a", "b", "c"], rows=1.0, features=1.1, save_every=3, **options)
    want, losses = _brute_boost(x, y, w, model.edges, **options)
    got = model.predict(df.where("id >= 0")).orderBy("id").toPandas()["prediction"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert losses[-1] < losses[0] < y.var() and max(len(t.values) for t in model.trees) == 5
    again = boosting.from_json(boosting.to_json(model))
    np.testing.assert_allclose(again.predict(df.where("id >= 0")).orderBy("id").toPandas()["prediction"], got, rtol=1e-12)
    shares = {r.feature: r.importance for r in boosting.importance_table(model, df).collect()}
    assert shares["a"] > shares["c"] and abs(sum(shares.values()) - 1) < 1e-9
    drawn = boosting.fit(df, ["a", "b", "c"], rows=0.7, features=0.7, **options)
    assert np.mean((drawn.predict(df.where("id >= 0")).orderBy("id").toPandas()["prediction"] - y) ** 2) < y.var()
    nothing = boosting.fit(df.where("label is null"), ["a"], **options)
    assert nothing.trees == [] and {r.prediction for r in nothing.predict(df).collect()} == {0.0}
