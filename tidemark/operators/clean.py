"""Cleaning of daily bars: canonical form, screening, liquidity, corporate actions."""

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import Trailing, clip, col, div, finite

#: A one-session move beyond this with no split recorded is taken for a data error.
MAX_MOVE = 0.60


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    if dict(df.dtypes)[name] == "string":
        return finite(F.expr(f"try_cast(trim(`{name}`) as double)"))
    return finite(F.col(name).cast("double"))


def canonical_bars(bars: DataFrame, *, order_by: Column | str | None = None, close_hour: int = 21) -> DataFrame:
    """One typed row per (ticker, session): defaults filled, rows without close or session dropped, last row kept.

    "Last" is decided by ``order_by`` (batch number, file order, load time). The duplicate choice is an aggregate,
    so copies collapse on the map side and a heavily repeated bar never travels as a group.
    """
    session = F.col(S.SESSION).cast("date")
    stamp = (
        F.col(S.AVAILABLE_AT).cast("timestamp") if S.AVAILABLE_AT in bars.columns
        else session.cast("timestamp") + F.make_interval(hours=F.lit(close_hour))
    )
    delisted = F.col("is_delisted").cast("boolean") if "is_delisted" in bars.columns else F.lit(False)
    typed = bars.select(
        F.col(S.TICKER).cast("string").alias(S.TICKER), session.alias(S.SESSION),
        *[_number(bars, c).alias(c) for c in (*S.PRICES, "volume")],
        F.coalesce(_number(bars, "split_factor"), F.lit(1.0)).alias("split_factor"),
        F.coalesce(_number(bars, "div_cash"), F.lit(0.0)).alias("div_cash"),
        stamp.alias(S.AVAILABLE_AT), F.coalesce(delisted, F.lit(False)).alias("is_delisted"),
        (col(order_by) if order_by is not None else F.lit(0)).alias("_order"),
    ).filter(F.col("close").isNotNull() & F.col(S.SESSION).isNotNull())
    values = [c for c in typed.columns if c not in (S.TICKER, S.SESSION, "_order")]
    last = typed.groupBy(S.TICKER, S.SESSION).agg(F.max(F.struct("_order", *values)).alias("r"))
    return last.select(S.TICKER, S.SESSION, *[F.col(f"r.{c}").alias(c) for c in values])


def screen_bars(bars: DataFrame, max_move: float = MAX_MOVE) -> DataFrame:
    """Drop bars that cannot be real.

    Prices must be positive and consistent; then a close that moved more than ``max_move`` from the previous bar
    that passed the first test, with no split, is dropped.
    """
    positive = F.lit(True)
    for c in S.PRICES:
        positive = positive & (F.col(c) > 0)
    consistent = (F.col("high") >= F.col("low")) & F.col("close").between(F.col("low") * 0.999, F.col("high") * 1.001)
    t = Trailing()
    sound = bars.filter(positive & consistent)
    move = F.abs(F.ln("close") - t.lag(F.ln("close")))
    flagged = sound.withColumn(
        "_jump", (move > math.log(1.0 + max_move)) & (F.coalesce(F.col("split_factor"), F.lit(1.0)) == 1.0))
    return flagged.filter(~F.coalesce(F.col("_jump"), F.lit(False))).drop("_jump")


def liquidity(bars: DataFrame, *, min_price: float, min_adv: float, window: int = 20) -> DataFrame:
    """Add trailing turnover (excluding the current bar) and the ``liquid`` flag."""
    adv = Trailing().mean(F.col("close") * F.col("volume"), window, max(5, window // 4), shift=1)
    return bars.withColumn("adv_notional", adv).withColumn(
        "liquid", (F.col("close") >= min_price) & (F.coalesce("adv_notional", F.lit(0.0)) >= min_adv))


def liquidity_eligible(panel: DataFrame, *, min_price: float, min_adv: float,
                       price: str = "close", adv: str = "adv_notional") -> DataFrame:
    """Eligibility of rows that already carry price and turnover; a missing column does not exclude."""
    price_ok = F.col(price) >= min_price if price in panel.columns else F.lit(True)
    adv_ok = F.coalesce(F.col(adv), F.lit(0.0)) >= min_adv if adv in panel.columns else F.lit(True)
    return panel.withColumn("eligible", price_ok & adv_ok)


def adjust_asof(bars: DataFrame, asof: date | None = None, *, dividends: bool = True) -> DataFrame:
    """Prices adjusted for the corporate actions known at ``asof``; no date means every action in the table.

    The factor of a session is the product of the steps strictly after it. Reading the series newest first makes
    that a running product, linear in the length of the series.
    """
    split, div_cash = F.coalesce("split_factor", F.lit(1.0)), F.coalesce("div_cash", F.lit(0.0))
    if asof is not None:
        known = F.col(S.SESSION) <= F.lit(asof).cast("date")
        split, div_cash = F.when(known, split).otherwise(1.0), F.when(known, div_cash).otherwise(0.0)
    step = F.lit(1.0) / F.when(split > 0, split).otherwise(1.0)
    if dividends:
        paid = F.when(F.col("close") > 0, div_cash / F.nullif("close", F.lit(0.0))).otherwise(0.0)
        step = step * (F.lit(1.0) - clip(paid, 0.0, 0.95))
    newest_first = Window.partitionBy(S.TICKER).orderBy(F.col(S.SESSION).desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product(F.col("_step")).over(newest_first), F.lit(1.0))
    out = bars.withColumn("_step", step).withColumn("adjustment_factor", factor).drop("_step")
    out = out.withColumns({c: F.col(c) * F.col("adjustment_factor") for c in S.PRICES if c in bars.columns})
    if "volume" in bars.columns:
        out = out.withColumn("volume", F.when(
            F.col("adjustment_factor") > 0, div("volume", "adjustment_factor")).otherwise(0.0))
    return out


def total_return(bars: DataFrame) -> DataFrame:
    """Per-session total return from raw prices, the split and the cash paid that day."""
    split = F.coalesce("split_factor", F.lit(1.0))
    prior = Trailing().lag("close") / F.when(split > 0, split).otherwise(1.0)
    return bars.withColumn("total_return", div(
        F.col("close") + F.coalesce("div_cash", F.lit(0.0)), prior) - 1.0)


def apply_delisting_returns(equity: DataFrame, delistings: DataFrame, weights: DataFrame,
                            delisting_return: float) -> DataFrame:
    """Scale an equity curve (session, equity) from each delisting on by ``1 + weight * delisting_return``."""
    hit = (
        delistings.join(weights, [S.TICKER, S.SESSION])
        .groupBy(S.SESSION).agg((F.sum("weight") * delisting_return).alias("impact"))
    )
    running = Window.orderBy(S.SESSION).rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    return (
        equity.join(hit, S.SESSION, "left")
        .withColumn("equity", F.col("equity") * F.product(1.0 + F.coalesce("impact", F.lit(0.0))).over(running))
        .drop("impact")
    )
