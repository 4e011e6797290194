"""Statistics of bounded frames from one pass, against Spark's windows; no frame is gone through again for each row."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import Trailing
from tidemark.functions.sliding import Sliding
from tidemark.operators import features
from tidemark.sources import fixtures as fx


def _asked(t):
    out = {}
    for rows, least, shift in ((5, 3, 0), (20, 15, 1), (40, 2, 7)):
        for fn in ("mean", "sum", "max", "min", "std"):
            out[f"{fn}_{rows}"] = getattr(t, fn)("x", rows, least, shift=shift)
    return out | t.power_sums("p", F.col("x") * 2, 9, order=4)


def test_statistics_are_those_of_windows_to_the_last_bit(spark):
    rng = np.random.default_rng(3)
    n = 700
    x = rng.normal(0, 1, n) * 10.0 ** rng.integers(-8, 8, n)
    pdf = pd.DataFrame({"ticker": rng.choice(["a", "b", "c", "d"], n, p=[0.9, 0.06, 0.03, 0.01]), "session": rng.permutation(n), "x": x})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([("only", 1, 2.0), (None, 1, 3.0), (None, 2, 4.0)], "ticker string, session long, x double"))
    df = df.withColumn("x", F.when(F.col("session") % 9 == 4, None).when(F.col("session") % 97 == 5, float("nan")).otherwise(F.col("x")))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")  # series lie over batches
    try:
        t = Sliding()
        asked = _asked(t) | {"since": t.since_high("x", 20, 10, 0.9)}
        got = t.fill(df, ["ticker", "session"]).select("ticker", "session", *[c.alias(k) for k, c in asked.items()]).toPandas()
        w = t.fill(df.withColumn("odd", F.col("session") % 2 == 1), ["ticker", "session"], "odd").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    u = Trailing()
    row, high = u.row(), u.max("x", 20, 10)
    last = F.last(F.when(F.col("x") >= F.col("_h") * 0.9, F.col("_r")), ignorenulls=True).over(u.window.rowsBetween(Window.unboundedPreceding, 0))
    want = df.withColumns({"_r": row, "_h": high}).select("ticker", "session", *[c.alias(k) for k, c in _asked(u).items()], (F.col("_r") - last).cast("double").alias("since")).toPandas()
    got, want = (v.sort_values(["ticker", "session"]).reset_index(drop=True) for v in (got, want))
    n_known = got["_p_n"].to_numpy() > 0  # sums of no values mean nothing
    for c in want.columns[2:]:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        same = (a == b) | (np.isnan(a) & np.isnan(b))
        assert same[n_known if c.startswith("_p_s") else slice(None)].all(), c
    assert w == df.where("session % 2 = 1").count()


def test_features_go_through_no_frame_again(spark):
    plan = features.price_features(fx.bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    daily = [line for line in plan.split("\n") if "ticker" in line]
    assert not re.search(r"RowFrame, -\d{2,}", "\n".join(line for line in daily if "[ticker" in line and "lag(" not in line))
    assert plan.count("MapInArrow") >= 2  # the features of each name, and those of the market
