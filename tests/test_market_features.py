"""Market features are the same bits whatever the order of the rows and whatever follows them."""

from pyspark.sql import functions as F

from tidemark.operators.features import market
from tidemark.operators.splits import lookahead_differences


def _bars(spark):
    day = F.date_add(F.lit("2000-01-03").cast("date"), (F.floor("id") % 150).cast("int"))
    rows = spark.range(150 * 400).select(F.concat(F.lit("S"), F.floor(F.col("id") / 150)).alias("ticker"), day.alias("session"),
                                         (50.0 + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1e4).alias("close"))
    return rows.select("*", F.col("close").alias("open"), (F.col("close") + 0.5).alias("high"), (F.col("close") - 0.5).alias("low"), F.lit(100.0).alias("volume"))


def test_market_features_do_not_depend_on_row_order(spark):
    bars = _bars(spark)
    found = [{tuple(r) for r in market.market_features(bars.repartition(n, F.xxhash64("ticker", F.lit(n)))).collect()} for n in (3, 7)]
    # an order that the sums of a session see: names change their tasks
    renamed = bars.withColumn("ticker", F.sha2("ticker", 256))
    found.append({tuple(r) for r in market.market_features(renamed).collect()})
    assert found[0] == found[1] == found[2]


def test_market_features_at_a_cut_off(spark):
    got = lookahead_differences(_bars(spark), "2000-05-01", list(market.OUTPUTS)).collect()
    assert {r.n_different for r in got} == {0} and {r.n_compared for r in got} == {400}


def test_spread_of_one_name_and_of_equal_names(spark):
    bars = _bars(spark).where("ticker = 'S1'")
    alone = market.market_features(bars).agg(F.count("dispersion_1w")).first()[0]
    twins = market.market_features(bars.union(bars.withColumn("ticker", F.lit("S2")))).agg(F.max("dispersion_1w"), F.count("dispersion_1w")).first()
    assert alone == 0 and twins[0] == 0.0 and twins[1] > 100
