"""What the panel's steps shuffle: ranked values as narrow rows, decision rows and not daily ones."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import features, labels
from tidemark.operators import calendar as cal
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _without_small_joins(spark, make):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ranked_rows_are_dealt_before_they_are_put_together(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("ticker"), *[F.rand(i).alias(f"v{i}") for i in range(5)])
    plan = _without_small_joins(spark, lambda: ranks.rank_pct(df, ["g"], [f"v{i}" for i in range(5)]))
    assert not re.search(r"Exchange hashpartitioning\(g[^\n]*ticker[^\n]*\n[^\n]*Aggregate[^\n]*partial", plan)  # partial sums hold a place for every column


def test_features_and_labels_leave_daily_rows_where_they_are(spark):
    bars = fx.bars(spark, SF)
    grid = cal.weekly_grid(cal.sessions(bars))
    marks = grid.select(F.col("decision_session").alias("session"))
    plan = _without_small_joins(spark, lambda: features.price_features(bars, marks))
    assert "SortMergeJoin [session" not in plan
    plan = _without_small_joins(spark, lambda: labels.build_labels(bars, grid))
    assert "SortMergeJoin" not in plan.split("HashAggregate")[0] and "BroadcastHashJoin [session" in plan


def test_ranks_with_copies_nulls_and_unusual_numbers(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 600), "ticker": [f"t{i}" for i in range(600)], "other": np.arange(600.0),
                        "a": rng.choice([0.0, -1.0, 1.0, 5e-324, 1e308, -1e308], 600), "b": rng.normal(0, 1, 600).round(1)})
    pdf.loc[pdf.index % 7 == 0, "a"] = np.nan
    pdf.loc[pdf.g == 1, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    got = ranks.rank_pct(df, ["g"], ["a", "b"]).toPandas().set_index("ticker").loc[pdf.ticker]
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c].to_numpy(float), pdf.groupby("g")[c].rank(pct=True).to_numpy(), rtol=1e-12)
    assert (got["other"].to_numpy() == pdf["other"].to_numpy()).all()
