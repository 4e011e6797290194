"""Market-state features: one row per session, joined back to every name of that session."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import Moments, Trailing, div, indicator, ln_pos
from tidemark.functions.sliding import Sliding

OUTPUTS = ("mkt_mom_4w", "mkt_mom_12w", "mkt_vol_13w", "mkt_vol_ratio", "breadth_above_sma50", "breadth_up_1w",
           "dispersion_1w", "mkt_drawdown")
WARMUP_SESSIONS = 260
YEAR = math.sqrt(252.0)


class _Sessions(Trailing):
    """Trailing windows over the session table, which is one row per day and needs no partitioning."""

    def __init__(self):
        self.window = Window.orderBy("session")


def _exact_sum(c) -> Column:
    """A sum that does not depend on the order of the rows: the values as decimals of 24 places."""
    return F.sum(c.cast("decimal(38,24)")).cast("double")


def market_features(bars: DataFrame) -> DataFrame:
    """Sums over the names of a session are exact, so later bars and other partitions change no bit of an earlier session's features."""
    t = Sliding()
    above = indicator(F.col("close") > t.mean("close", 50, 35))
    names = t.fill(bars.select("ticker", "session", "close", (ln_pos("close") - t.lag(ln_pos("close"))).alias("ret")), ["session", "close", "ret"])
    names = names.select("session", "ret", above.alias("above"))
    daily = names.groupBy("session").agg(
        F.count("ret").cast("double").alias("_ret_n"), _exact_sum(F.col("ret")).alias("_ret_s1"), _exact_sum(F.col("ret") * F.col("ret")).alias("_ret_s2"),
        F.avg("above").alias("breadth_above_sma50"), F.avg(indicator(F.col("ret") > 0)).alias("up"))
    spread = Moments("ret", 2)
    daily = daily.withColumns({"mkt": spread.mean, "spread": spread.std()})
    s = _Sessions()
    daily = daily.withColumns({
        "index": s.running(F.sum, F.coalesce("mkt", F.lit(0.0))),
        "mkt_vol_13w": s.std("mkt", 65, 40) * YEAR, "vol_26w": s.std("mkt", 130, 80) * YEAR,
        "breadth_up_1w": s.mean("up", 5, 3), "dispersion_1w": s.mean("spread", 5, 3) * YEAR,
    })
    daily = daily.withColumns({
        "mkt_mom_4w": F.col("index") - s.lag("index", 20), "mkt_mom_12w": F.col("index") - s.lag("index", 60),
        "mkt_vol_ratio": div("mkt_vol_13w", "vol_26w"), "mkt_drawdown": F.col("index") - s.running(F.max, "index"),
    })
    return daily.select("session", *OUTPUTS)
