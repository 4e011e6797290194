"""Ranks, medians and bars of the panel without a row for each value: same results, at any size of group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.operators import fold_ridge
from tidemark.sources import fixtures as fx


def _mixed(rows: int) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, rows), "ticker": [f"t{i}" for i in range(rows)], "other": np.arange(float(rows)),
                        "a": rng.choice([0.0, -0.0, 1.0, -1.0, 5e-324, 1e308], rows), "b": rng.normal(0, 1, rows)})
    pdf.loc[pdf.index % 7 == 0, "a"] = np.nan
    return pdf


@pytest.mark.parametrize("most", [100, 1 << 17])
def test_ranks_in_ranges_of_values(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "RANGE_ROWS", most, raising=False)
    pdf = _mixed(3000)
    ranked = ranks.rank_pct(spark.createDataFrame(pdf).repartition(5), ["g"], ["a", "b"])
    assert "Generate explode" not in ranked._jdf.queryExecution().executedPlan().toString()  # values travel as arrays
    got = ranked.toPandas().set_index("ticker").loc[pdf.ticker]
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c].to_numpy(float), pdf.groupby("g")[c].rank(pct=True).to_numpy(), rtol=1e-14)
    assert (got["other"].to_numpy() == pdf["other"].to_numpy()).all()


def test_rows_without_a_ticker_or_group_keep_their_rank(spark):
    df = spark.createDataFrame([("x", None, 1.0), ("x", "t", 2.0), (None, "u", 5.0), (None, None, 4.0), ("x", "n", None)], "g string, ticker string, v double")
    got = sorted(r.v for r in ranks.rank_pct(df, ["g"], ["v"]).collect() if r.v is not None)
    assert got == [0.5, 0.5, 1.0, 1.0]


def test_fold_medians_from_arrays(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"set": rng.choice(["0", "0,1", "1"], 500), "x0": rng.normal(0, 1, 500), "x1": rng.integers(-2, 3, 500).astype(float), "x2": np.full(500, np.nan)})
    pdf.loc[pdf.index % 5 == 0, "x0"] = np.nan
    got = fold_ridge._medians(spark.createDataFrame(pdf).repartition(3), 3)
    for fold in (0, 1):
        some = pdf[pdf["set"].str.split(",").map(lambda s, k=str(fold): k in s)]
        for i in (0, 1):
            assert got[fold, i] == pytest.approx(some[f"x{i}"].median(), abs=1e-15)
    assert (0, 2) not in got
    made = ranks.values_within(spark.createDataFrame(pdf.drop(columns="x2")), "set", 2, {1: [0]})
    assert sorted({(r.i, r.v) for r in made.collect()}) == [(1, 0.0)]


def test_bars_open_and_close_by_line_then_price(spark, tmp_path):
    lines = pd.DataFrame([(7, 2, 10.0), (7, 1, 12.0), (7, 1, 11.0), (9, 1, 8.0), (9, 1, 9.0)], columns=["l_orderkey", "l_linenumber", "l_extendedprice"])
    df = spark.createDataFrame(lines).select("*", F.lit(3).cast("long").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.lit("1995-01-03 00:00:00").cast("timestamp").alias("l_shipdate"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = fx.bars(spark, str(tmp_path))
    assert "decimal(38" not in made._jdf.queryExecution().analyzed().toString()  # a number of 38 digits for each line
    r = made.collect()[0]
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (11.0, 12.0, 8.0, 9.0, 5.0)
