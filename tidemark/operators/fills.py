"""Realised execution cost: fills against the prices their orders were computed from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ranks
from tidemark.functions.exprs import col, div

# A fill farther off is a typo; band of agreement; fills and weeks needed for a verdict.
IMPLAUSIBLE_BPS = 2_000.0
BAND_BPS = 15.0
MIN_FILLS, MIN_WEEKS = 8, 4


def slippage_bps(side, reference, fill) -> Column:
    """Positive is always a cost."""
    sign = F.when(F.lower(col(side)) == "buy", 1.0).otherwise(-1.0)
    return F.when(col(reference) > 0, sign * div(col(fill) - col(reference), reference) * 10_000.0).otherwise(0.0)


def judge_fills(fills: DataFrame, orders: DataFrame, key=("client_order_id",)) -> DataFrame:
    """Each recorded fill with its slippage and the reason it is left out, if any; fills without a price are no fills."""
    o = orders.select(*key, "side", "est_price", F.col("quantity").alias("_ordered"), "expected_slip_bps", F.lit(True).alias("_known"))
    both = fills.filter("price > 0").join(o, list(key), "left")
    done = F.when(F.coalesce("quantity", F.lit(0.0)) != 0, F.col("quantity")).otherwise(F.coalesce("_ordered", F.lit(0.0)))
    bps = slippage_bps("side", "est_price", "price")
    reason = (
        F.when(F.col("_known").isNull(), "unattributed").when(F.coalesce("est_price", F.lit(0.0)) <= 0, "no reference")
        .when(F.col("quantity") <= 0, "zero quantity").when(F.abs("slippage_bps") > IMPLAUSIBLE_BPS, "implausible"))
    return both.withColumn("quantity", done).withColumns({"slippage_bps": bps, "notional": F.col("price") * F.col("quantity")}
                                                         ).withColumn("dropped", reason).drop("_known", "_ordered")


def _bands(surprise: Column) -> Column:
    return F.when(surprise.isNull(), "no expectation").when(surprise > BAND_BPS, "worse than modelled").when(
        surprise < -BAND_BPS, "better than modelled").otherwise("as modelled")


def analyse_fills(fills: DataFrame, orders: DataFrame, by=("run",), key=("client_order_id",)) -> DataFrame:
    """Per run: coverage, notional-weighted and median slippage, expectation, cost, and a verdict or a refusal."""
    judged = judge_fills(fills, orders, key)
    used = F.col("dropped").isNull()
    n = lambda c, keep=used: F.sum(F.when(keep, c))
    modelled = used & F.col("expected_slip_bps").isNotNull()
    per = judged.groupBy(*by).agg(
        F.count_if(used).alias("n_filled"), F.count_if(F.col("dropped") == "unattributed").alias("n_unattributed"),
        F.count_if(F.col("dropped").isNotNull()).alias("n_dropped"), F.coalesce(n(F.col("notional")), F.lit(0.0)).alias("total_notional"),
        div(n(F.col("slippage_bps") * F.col("notional")), n(F.col("notional"))).alias("weighted_slippage_bps"),
        div(n(F.col("expected_slip_bps") * F.col("notional"), modelled), n(F.col("notional"), modelled)).alias("weighted_expected_bps"),
        F.coalesce(n(F.col("slippage_bps") / 10_000.0 * F.col("notional")), F.lit(0.0)).alias("slippage_cost"))
    total = orders.groupBy(*by).agg(F.count("*").alias("n_orders"))
    # from counts of values, so that a run of any size is no single task
    middle = ranks.quantiles(judged.filter(used), list(by), "slippage_bps", [0.5]).select(*by, F.col("q")[0].alias("median_slippage_bps"))
    out = total.join(per.join(middle, list(by), "left"), list(by), "left").withColumn("n_filled", F.coalesce("n_filled", F.lit(0)))
    surprise = F.col("weighted_slippage_bps") - F.col("weighted_expected_bps")
    return out.withColumns({"coverage": F.col("n_filled") / F.col("n_orders"), "surprise_bps": surprise}).withColumn(
        "verdict", F.when(F.col("n_filled") == 0, "no fills").when(F.col("n_filled") < MIN_FILLS, "too few fills").otherwise(
            _bands(F.col("surprise_bps"))))


def pool_weeks(weeks: DataFrame) -> DataFrame:
    """Pool the weeks by notional; no verdict below four of them."""
    w = weeks.filter("n_filled > 0")
    has = F.col("weighted_expected_bps").isNotNull()
    out = w.agg(
        F.count("*").alias("n_weeks"), F.sum("total_notional").alias("total_notional"), F.sum("slippage_cost").alias("slippage_cost"),
        (div(F.sum("slippage_cost"), F.sum("total_notional")) * 10_000.0).alias("realised_bps"),
        div(F.sum(F.when(has, F.col("weighted_expected_bps") * F.col("total_notional"))),
            F.sum(F.when(has, F.col("total_notional")))).alias("expected_bps"))
    return out.withColumn("surprise_bps", F.col("realised_bps") - F.col("expected_bps")).withColumn(
        "verdict", F.when(F.col("n_weeks") < MIN_WEEKS, "too few weeks").otherwise(_bands(F.col("surprise_bps"))))
