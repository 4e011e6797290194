"""Transaction costs as column expressions over a fee schedule."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import col

BPS = 1e-4
MAX_HALF_SPREAD_BPS = 50.0
DEFAULT_VOL = 0.30
COMPONENTS = ("commission", "taxes", "spread", "impact", "borrow", "roll")


@dataclass(frozen=True)
class Fees:
    """Basis points of notional unless the name says otherwise."""

    commission: float = 0.5
    min_commission: float = 0.0
    regulatory_sell: float = 0.0
    min_half_spread: float = 2.0
    spread_from_range: float = 0.25
    impact_k: float = 0.5
    borrow_annual: float = 50.0
    tax_buy: float = 0.0
    tax_sell: float = 0.0
    stamp: float = 0.0
    exchange: float = 0.0
    gst_rate: float = 0.0
    futures_commission: float = 0.0
    futures_tax_sell: float = 0.0
    futures_exchange: float = 0.0
    futures_stamp: float = 0.0
    futures_roll: float = 0.0
    futures_shorts: bool = False
    scale: float = 1.0


# The two market schedules.
US = Fees(commission=0.5, regulatory_sell=0.3, min_half_spread=2.0, spread_from_range=0.010, impact_k=0.5, borrow_annual=50.0)
INDIA = Fees(commission=3.0, min_half_spread=3.0, spread_from_range=0.020, impact_k=0.6, borrow_annual=200.0, tax_buy=10.0,
             tax_sell=10.0, stamp=1.5, exchange=0.30, gst_rate=0.18, futures_commission=2.0, futures_tax_sell=2.0,
             futures_exchange=0.20, futures_stamp=0.2, futures_roll=4.0, futures_shorts=True)


def half_spread_bps(day_range, fees: Fees) -> Column:
    """From the name's own daily range, between the floor and fifty basis points."""
    r = col(day_range)
    estimate = F.greatest(F.lit(fees.min_half_spread), F.least(r * 10_000.0 * fees.spread_from_range, F.lit(MAX_HALF_SPREAD_BPS)))
    return F.when(r > 0, estimate).otherwise(fees.min_half_spread)


def impact_bps(notional, vol, adv, fees: Fees) -> Column:
    """Square root of the share of daily turnover, scaled by daily volatility."""
    share = F.least(col(notional) / F.nullif(col(adv), F.lit(0.0)), F.lit(1.0))
    daily = F.coalesce(col(vol), F.lit(DEFAULT_VOL)) / 252.0 ** 0.5 * 10_000.0
    return F.when(col(adv) > 0, fees.impact_k * daily * F.sqrt(share)).otherwise(0.0)


def trade_cost(notional, is_buy, is_short_leg, fees: Fees, *, vol="volatility", adv="adv_notional",
               day_range="hl_range") -> dict[str, Column]:
    """Commission, taxes, spread and impact of a trade, zero for no notional."""
    n, buy = col(notional), col(is_buy)
    futures = col(is_short_leg) if fees.futures_shorts else F.lit(False)
    pick = lambda future, cash: F.when(futures, future).otherwise(cash)
    by_side = lambda b, s: F.when(buy, float(b)).otherwise(float(s))
    commission = F.greatest(n * pick(fees.futures_commission, fees.commission) * BPS, F.lit(fees.min_commission))
    exchange = n * pick(fees.futures_exchange, fees.exchange) * BPS
    tax = pick(by_side(0.0, fees.futures_tax_sell), by_side(fees.tax_buy, fees.tax_sell + fees.regulatory_sell))
    stamp = pick(by_side(fees.futures_stamp, 0.0), by_side(fees.stamp, 0.0))
    parts = {
        "commission": commission,
        "taxes": n * (tax + stamp) * BPS + exchange + (commission + exchange) * fees.gst_rate,
        "spread": n * half_spread_bps(day_range, fees) * BPS,
        "impact": n * impact_bps(n, vol, adv, fees) * BPS,
    }
    return {k: F.when(n > 0, v * fees.scale).otherwise(0.0) for k, v in parts.items()}


def holding_cost(short_notional, sessions_held: int, rolls: int, fees: Fees) -> dict[str, Column]:
    n = F.greatest(F.coalesce(col(short_notional), F.lit(0.0)), F.lit(0.0)) * (1.0 if sessions_held > 0 else 0.0)
    roll = n * fees.futures_roll * BPS * rolls if fees.futures_shorts else F.lit(0.0)
    return {"borrow": n * (fees.borrow_annual * BPS / 252.0) * sessions_held * fees.scale, "roll": roll * fees.scale}


def rebalance_cost(books: DataFrame, weeks: DataFrame, stats: DataFrame, fees: Fees, *, capital: float = 1.0,
                   sessions_held: int = 5, by=()) -> DataFrame:
    """Cost components and one-way turnover of moving from each week's book to the next.

    Every book row appears twice, as this week's target and as next week's starting point, and one aggregate puts the
    two sides of a name together; a full join of a table with itself is not needed. ``weeks`` orders the decisions.
    """
    from pyspark.sql import Window

    order = weeks.select(S.DECISION).distinct().withColumn("_next", F.lead(S.DECISION).over(Window.orderBy(S.DECISION)))
    seen = books.join(order, S.DECISION).select(
        *by, S.TICKER, F.explode(F.array(
            F.struct(F.col(S.DECISION).alias("d"), F.col("weight").alias("now"), F.lit(0.0).alias("before")),
            F.struct(F.col("_next").alias("d"), F.lit(0.0).alias("now"), F.col("weight").alias("before")))).alias("x"))
    moves = seen.select(*by, S.TICKER, F.col("x.d").alias(S.DECISION), "x.now", "x.before").filter(F.col(S.DECISION).isNotNull())
    moves = moves.groupBy(*by, S.DECISION, S.TICKER).agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    change = F.col("now") - F.col("before")
    moves = moves.join(stats.select(S.DECISION, S.TICKER, "volatility", "adv_notional", "hl_range"), [S.DECISION, S.TICKER], "left")
    notional = F.when(F.abs(change) >= 1e-9, F.abs(change) * capital).otherwise(0.0)
    parts = trade_cost(notional, change > 0, (F.col("now") < 0) | (F.col("before") < 0), fees)
    totals = moves.withColumns(parts).groupBy(*by, S.DECISION).agg(
        *[F.sum(c).alias(c) for c in parts], (F.sum(F.abs(change)) / 2.0).alias("turnover"),
        (F.sum(F.when(F.col("now") < 0, -F.col("now")).otherwise(0.0)) * capital).alias("_short"))
    held = holding_cost("_short", sessions_held, 1 if sessions_held >= 21 else 0, fees)
    out = totals.withColumns(held).drop("_short")
    total = sum((F.col(c) for c in COMPONENTS), F.lit(0.0))
    return out.withColumn("total", total)


def round_trip_bps(fees: Fees, rows: DataFrame, *, is_short: bool = False, notional: float = 1e6, adv: float = 1e8) -> DataFrame:
    """Cost in basis points of buying and selling ``notional``, for each row's volatility and range."""
    legs = [trade_cost(F.lit(notional), F.lit(buy), F.lit(is_short), fees, adv=F.lit(adv)) for buy in (True, False)]
    total = sum((c for leg in legs for c in leg.values()), F.lit(0.0))
    return rows.withColumn("round_trip_bps", total / notional * 10_000.0)


def expected_slippage(orders: DataFrame, stats: DataFrame, fees: Fees) -> DataFrame:
    """Spread and impact expected of each order in basis points, as known before the fill."""
    known = stats.select(S.TICKER, "volatility", "adv_notional", "hl_range")
    short = (F.col("instrument") != "equity") if fees.futures_shorts else (F.col("instrument") == "equity_short")
    parts = trade_cost("est_value", F.col("side") == "buy", short, fees)
    bps = F.round((parts["spread"] + parts["impact"]) / F.nullif("est_value", F.lit(0.0)) * 10_000.0, 4)
    return orders.join(known, S.TICKER, "left").withColumn(
        "expected_slip_bps", F.when(F.col("est_value") > 0, bps)).drop("volatility", "adv_notional", "hl_range")
