"""Feature blocks made of trailing windows only: price, moments, technical (non-recursive), patterns.

Each block gives its columns in levels; level *n* may use any column of the levels before it. ``_lc`` (log close),
``_ret`` (log return), ``_pc`` (previous close) and the shared range columns mean the same in every block. Levels that
read statistics of bounded frames are marked ``After``.
"""

import math

from pyspark.sql import functions as F

from tidemark.functions.exprs import Moments, clip, div, indicator, ln_pos
from tidemark.functions.sliding import Sliding
from tidemark.operators.features.registry import After, register

YEAR = math.sqrt(252.0)


def _base(t: Sliding) -> dict:
    return {"_lc": ln_pos("close"), "_pc": t.lag("close")}


def _returns(t: Sliding) -> dict:
    return {"_ret": F.col("_lc") - t.lag("_lc")}


def _return_sums(t: Sliding) -> dict:
    """Power sums of the quarter's returns, shared by the volatility and the higher-moment features."""
    return t.power_sums("r65", "_ret", 65, order=4)


def _extremes(t: Sliding) -> dict:
    """Trailing high and low used by several blocks, computed once."""
    return {
        "_h20": t.max("high", 20, 15), "_l20": t.min("low", 20, 15),
        "_h60": t.max("high", 60, 40), "_l60": t.min("low", 60, 40),
        "_c252": t.max("close", 252, 120),
    }


@register(
    "price",
    ("mom_4w", "mom_12w", "mom_26w", "mom_52w_skip4w", "reversal_1w", "reversal_2w", "vol_13w", "vol_26w", "vol_ratio",
     "downside_vol_13w", "range_pct_4w", "dist_52w_high", "dist_52w_low", "volume_z_13w", "dollar_vol_log", "gap_1d",
     "close_to_high_1w"),
    260,
)
def price(t: Sliding):
    change = lambda n: F.col("_lc") - t.lag("_lc", n)
    high5, low5 = t.max("high", 5, 3), t.min("low", 5, 3)
    return [
        _base(t) | {"_logv": F.log1p(F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))},
        _returns(t) | {
            "mom_4w": change(20), "mom_12w": change(60), "mom_26w": change(130),
            "mom_52w_skip4w": change(252) - change(20), "reversal_1w": -change(5), "reversal_2w": -change(10),
            "dollar_vol_log": F.log1p(F.col("close") * F.col("volume")),
            "gap_1d": ln_pos(div("open", "_pc")),
        },
        {"_down": F.when(F.col("_ret") < 0.0, F.col("_ret")).otherwise(0.0)},
        After(_extremes(t) | _return_sums(t) | t.power_sums("r130", "_ret", 130) | t.power_sums("down", "_down", 65)
              | t.power_sums("lv", "_logv", 65, shift=1)),
        After({
            "dist_52w_low": div("close", t.min("close", 252, 120)) - 1.0,
            "close_to_high_1w": div(F.col("close") - low5, high5 - low5),
            "range_pct_4w": div(F.col("_h20") - F.col("_l20"), "close"),
            "dist_52w_high": div("close", "_c252") - 1.0,
            "volume_z_13w": div(t.value("_logv") - Moments("lv", 40).mean, Moments("lv", 40).std()),
            "vol_13w": Moments("r65", 40).std() * YEAR, "vol_26w": Moments("r130", 80).std() * YEAR,
            "downside_vol_13w": Moments("down", 40).std() * YEAR,
        }),
        After({"vol_ratio": div("vol_13w", "vol_26w")}),
    ]


@register("moments", ("skew_13w", "kurt_13w", "max_ret_1m", "min_ret_1m", "up_day_frac_13w"), 90)
def moments(t: Sliding):
    return [
        _base(t),
        _returns(t),
        After(_return_sums(t) | {
            "max_ret_1m": t.max("_ret", 21, 15), "min_ret_1m": t.min("_ret", 21, 15),
            "up_day_frac_13w": t.mean(indicator(F.col("_ret") > 0), 65, 40),
        }),
        After({"skew_13w": Moments("r65", 40).skew(), "kurt_13w": Moments("r65", 40).kurt()}),
    ]


@register(
    "technical",
    ("sma_ratio_10_50", "sma_ratio_20_200", "px_over_sma50", "px_over_sma200", "stoch_k_14", "bb_position_20",
     "bb_width_20", "obv_slope_20", "money_flow_14"),
    220,
)
def technical(t: Sliding):
    low14, high14 = t.min("low", 14, 10), t.max("high", 14, 10)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    flow = F.col("_typical") * F.col("volume")
    step = F.col("_typical") - t.lag("_typical")
    signed = F.coalesce(F.signum(F.col("close") - F.col("_pc")), F.lit(0.0)) * F.col("volume")
    return [
        _base(t) | {"_typical": typical},
        {
            "_pos": F.when(step > 0, flow).otherwise(0.0), "_neg": F.when(step < 0, flow).otherwise(0.0),
            "_obv": t.running(F.sum, signed),
        },
        {"_obv_change": F.col("_obv") - t.lag("_obv", 20)},
        After({
            "_sma10": t.mean("close", 10, 8), "_sma20": t.mean("close", 20, 15), "_sma50": t.mean("close", 50, 35),
            "_sma200": t.mean("close", 200, 140), "_std20": t.std("close", 20, 15), "_v20": t.mean("volume", 20, 15),
            "stoch_k_14": div(100.0 * (F.col("close") - low14), high14 - low14),
        }),
        After({
            "sma_ratio_10_50": div("_sma10", "_sma50") - 1.0, "sma_ratio_20_200": div("_sma20", "_sma200") - 1.0,
            "px_over_sma50": div("close", "_sma50") - 1.0, "px_over_sma200": div("close", "_sma200") - 1.0,
            "bb_position_20": div(F.col("close") - F.col("_sma20"), 2.0 * F.col("_std20")),
            "bb_width_20": div(4.0 * F.col("_std20"), "_sma20"),
            "obv_slope_20": div(t.value("_obv_change"), F.col("_v20") * 20.0),
            "money_flow_14": 100.0 - 100.0 / (1.0 + div(t.sum("_pos", 14, 10), t.sum("_neg", 14, 10))),
        }),
    ]


@register(
    "patterns",
    ("higher_highs_12w", "higher_lows_12w", "trend_structure", "breakout_20d", "breakout_60d", "breakdown_20d",
     "dist_resistance_60d", "dist_support_60d", "squeeze_ratio", "consolidation_20d", "gap_unfilled",
     "inside_bar_frac_4w", "body_ratio_1w", "volume_breakout_conf", "days_since_52w_high", "pullback_from_high_20d"),
    140,
)
def patterns(t: Sliding, confirm: int = 3):
    c = F.col
    gap = div(c("open") - c("_pc"), "_pc")
    above = F.coalesce((gap > 0.005) & (c("low") > c("_pc")), F.lit(False)).cast("double")
    below = F.coalesce((gap < -0.005) & (c("high") < c("_pc")), F.lit(False)).cast("double")
    inside = F.when(t.lag("high").isNotNull(),
                    F.coalesce((c("high") <= t.lag("high")) & (c("low") >= t.lag("low")), F.lit(False)).cast("double"))
    body = div(F.abs(c("close") - c("open")), c("high") - c("low"))
    rose = lambda now, before: F.when(
        before.isNotNull(), F.coalesce(now > before, F.lit(False)).cast("double"))
    volume_ratio = div("volume", t.mean("volume", 20, 15, shift=1))
    return [
        _base(t),
        {"_inside": inside, "gap_unfilled": F.when(c("_pc").isNotNull(), above - below)},
        After(_extremes(t) | {
            "body_ratio_1w": t.mean(body, 5, 3),
            "pullback_from_high_20d": div("close", t.max("close", 20, 15)) - 1.0,
            "inside_bar_frac_4w": t.mean("_inside", 20, 15),
            "_confirm": F.log1p(clip(volume_ratio, low=0.0)),
            "days_since_52w_high": clip(t.since_high("close", 252, 120, 0.999), high=252.0),
        }),
        After({
            "higher_highs_12w": rose(c("_h60"), t.max("high", 60, 40, shift=60)),
            "higher_lows_12w": rose(c("_l60"), t.min("low", 60, 40, shift=60)),
            "breakout_20d": div("close", t.max("high", 20, 15, shift=1)) - 1.0, "breakout_60d": div("close", t.max("high", 60, 40, shift=1)) - 1.0,
            "breakdown_20d": div("close", t.min("low", 20, 15, shift=1)) - 1.0,
            "dist_resistance_60d": div(t.max("high", 60, 40, shift=confirm) - c("close"), "close"),
            "dist_support_60d": div(c("close") - t.min("low", 60, 40, shift=confirm), "close"),
            "squeeze_ratio": div(c("_h20") - c("_l20"), c("_h60") - c("_l60")),
            "consolidation_20d": div(c("_h20") - c("_l20"), "close"),
        }),
        After({
            "trend_structure": c("higher_highs_12w") + c("higher_lows_12w") - 1.0,
            "volume_breakout_conf": F.signum(F.coalesce("breakout_20d", F.lit(0.0))) * c("_confirm"),
        }),
    ]
