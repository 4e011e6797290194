"""Quantiles of few groups: exact, and only values near them are shuffled."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import fold_ridge


def test_quantiles_of_few_groups_are_exact(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "v": rng.choice([0.0, -1.0, 1e-300, 3.5, 1e300, np.nan], 3000) + np.where(rng.random(3000) < 0.5, rng.normal(0, 1, 3000), 0.0)})
    pdf.loc[pdf.g == 2, "v"] = 7.0
    probs = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]
    df = spark.createDataFrame(pdf).withColumn("k", F.lit(2))
    for times in (None, "k"):
        a, b = ({r.g: (r.q, r.n) for r in ranks.quantiles(df, ["g"], "v", probs, times=times, few=few).collect()} for few in (True, False))
        assert a == b and len(a) == 3


def test_medians_of_folds_shuffle_few_values(spark):
    rng = np.random.default_rng(6)
    n = 20000
    pdf = pd.DataFrame({"set": rng.choice(["0,1", "1", "0"], n), "x0": rng.normal(0, 1, n), "x1": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 4, n))})
    rows = spark.createDataFrame(pdf).withColumn("x1", F.when(~F.isnan("x1"), F.col("x1")))
    stages = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in _all(spark, stages))
    before = shuffled()
    got = fold_ridge._medians(rows, 2)
    assert shuffled() - before < n  # 35,000 values, nearly all different
    for fold in (0, 1):
        mine = pdf[pdf["set"].str.contains(str(fold))]
        assert got[fold, 0] == np.median(mine.x0) and got[fold, 1] == np.median(mine.x1.dropna())


def _all(spark, store):
    gateway = spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]
