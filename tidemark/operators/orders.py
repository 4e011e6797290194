"""Target books to orders, the sequence to work them in, holdings, and capital adequacy."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S

# Order in which a desk works its tickets.
STEPS = {"close": 0, "reduce": 1, "open_short": 2, "open_long": 3}


def build_orders(book: DataFrame, prices: DataFrame, holdings: DataFrame, lots: DataFrame, *, equity: float, lot_size: int = 1,
                 derivative_lot: int = 1, min_value: float = 0.0) -> DataFrame:
    """Orders that move the holdings to the book, with shares cut toward zero to a whole lot.

    Rows with ``below_one_lot`` carry no order: the account is too small for one lot. A derivative without a declared
    lot is tagged ``lot-unknown``.
    """
    c = F.col
    both = (
        book.select(S.TICKER, "weight", "instrument").join(holdings.select(S.TICKER, "shares"), S.TICKER, "full")
        .join(prices.select(S.TICKER, "price"), S.TICKER).filter("price > 0").join(lots.select(S.TICKER, "lot_size"), S.TICKER, "left")
        .withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "shares": F.coalesce("shares", F.lit(0.0)),
                      "instrument": F.coalesce("instrument", F.lit("equity"))})
    )
    derivative = ~c("instrument").isin("equity", "equity_short")
    declared = F.when(c("lot_size") > 1, c("lot_size")).otherwise(derivative_lot)
    unit = F.when(derivative, declared).otherwise(max(1, lot_size)).cast("double")
    wanted = c("weight") * equity / c("price")
    sized = both.withColumn("_unit", unit).withColumn(
        "target_shares", F.floor(F.abs(wanted) / c("_unit")) * c("_unit") * F.signum(wanted))
    change = c("target_shares") - c("shares")
    out = sized.withColumn("quantity", F.abs(change)).withColumns({
        "side": F.when(change > 0, "buy").otherwise("sell"), "est_price": c("price"), "est_value": F.abs(change) * c("price"),
        "tag": F.when(derivative & (c("_unit") <= 1), "lot-unknown").otherwise(""),
        "below_one_lot": (c("target_shares") == 0) & (F.abs("weight") > 1e-9) & (c("_unit") > 1)})
    placed = (c("quantity") >= 1e-9) & (c("est_value") >= min_value)
    return out.withColumn("is_order", placed).filter(placed | c("below_one_lot")).select(
        S.TICKER, "side", "quantity", "instrument", "est_price", "est_value", "tag", "below_one_lot", "is_order")


def summarise_orders(orders: DataFrame) -> DataFrame:
    value = lambda side: F.sum(F.when(F.col("side") == side, F.col("est_value")).otherwise(0.0))
    return orders.agg(F.count("*").alias("n_orders"), value("buy").alias("buy_value"), value("sell").alias("sell_value"),
                      F.sum("est_value").alias("gross_value"))


def positions_after(holdings: DataFrame, orders: DataFrame) -> DataFrame:
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    moves = holdings.select(S.TICKER, "shares").unionByName(orders.select(S.TICKER, signed.alias("shares")))
    return moves.groupBy(S.TICKER).agg(F.sum("shares").alias("shares")).filter(F.abs("shares") > 1e-9)


def execution_sequence(orders: DataFrame, by=()) -> DataFrame:
    """Closes, reductions, new shorts, new longs; largest first within each; with the cash each frees or needs."""
    short = F.col("instrument").isin("futures", "equity_short")
    sell = F.col("side") == "sell"
    step = F.when(short & sell, "open_short").when(short, "close").when(sell, "reduce").otherwise("open_long")
    rank = F.when(F.col("step") == "close", 0).when(F.col("step") == "reduce", 1).when(F.col("step") == "open_short", 2).otherwise(3)
    cash = F.when(F.col("step").isin("close", "reduce"), F.col("est_value")).when(
        F.col("step") == "open_long", -F.col("est_value")).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(rank, F.col("est_value").desc(), S.TICKER))
    return orders.withColumn("step", step).withColumns({"position": place, "cash_effect": cash})


def held_weights(holdings: DataFrame, prices: DataFrame, equity: float) -> DataFrame:
    return holdings.join(prices.select(S.TICKER, "price"), S.TICKER).filter("price <> 0").select(
        S.TICKER, (F.col("shares") * F.col("price") / equity).alias("weight"))


def capital_adequacy(lots: DataFrame, prices: DataFrame, *, equity: float, max_weight: float) -> DataFrame:
    """Per name: value of one lot, the account it first fits, and whether it fits this one."""
    one = F.col("lot_size") * F.col("price")
    return lots.filter("lot_size > 1").join(prices.select(S.TICKER, "price"), S.TICKER).filter("price <> 0").select(
        S.TICKER, "lot_size", "price", one.alias("one_lot_notional"), (one / max_weight).alias("minimum_equity"),
        (F.lit(equity > 0) & (one <= equity * max_weight)).alias("tradeable"))


def adequacy_verdict(constraints: DataFrame) -> DataFrame:
    n = F.count_if("tradeable")
    return constraints.agg(F.count("*").alias("n_shortable"), n.alias("n_tradeable"), F.min("minimum_equity").alias("minimum_equity_for_any"),
                           F.when(F.count("*") == 0, "nothing to check").when(n == 0, "none fits").when(n < 7, "few fit")
                           .otherwise("fits").alias("verdict"))


