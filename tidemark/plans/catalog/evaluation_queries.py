"""Queries over ledgers, orders, paths and single decisions, and the file sources that name tickers by file."""

from pyspark.sql import functions as F

from tidemark.operators import costs, evaluation, models, orders, performance
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import feature_queries as FQ
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise, scratch_path
from tidemark.sources import bars as src
from tidemark.sources import fixtures as fx
from tidemark.sources import tables
from tidemark.streaming import ingest

LEDGER = """
ledger AS (SELECT l_returnflag AS scenario, date_trunc('week', l_shipdate)::DATE AS decision_session, avg(l_discount) - 0.05 AS gross_return,
             avg(l_tax) / 20 AS cost, avg(l_quantity) / 100 AS turnover, max(l_discount) AS gross_exposure, 0.0::DOUBLE AS net_exposure
           FROM lineitem GROUP BY 1, 2)"""


def ledger(spark, d):
    """A weekly ledger for each return flag."""
    li = fx.table(spark, d, "lineitem")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    out = li.groupBy(F.col("l_returnflag").alias("scenario"), week.alias("decision_session")).agg(
        (F.avg("l_discount") - 0.05).alias("gross_return"), (F.avg("l_tax") / 20).alias("cost"), (F.avg("l_quantity") / 100).alias("turnover"),
        F.max("l_discount").alias("gross_exposure"), F.lit(0.0).alias("net_exposure"))
    return out.withColumn("net_return", F.col("gross_return") - F.col("cost"))


@query("v22_cost_sensitivity", B.with_(LEDGER, """
s AS (SELECT *, unnest([0.5, 1.0, 2.0, 3.0])::DOUBLE AS cost_scale FROM ledger),
n AS (SELECT *, gross_return - cost * cost_scale AS r FROM s),
e AS (SELECT *, product(1 + r) OVER (PARTITION BY scenario, cost_scale ORDER BY decision_session) AS eq FROM n),
dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY scenario, cost_scale ORDER BY decision_session) - 1 AS dd FROM e)""") + """
SELECT scenario, cost_scale, count(*) AS n_periods, avg(r) * 52 AS ann_return, avg(r) * 52 / (stddev_samp(r) * sqrt(52.0)) AS sharpe,
       min(dd) AS max_drawdown, avg(cost * cost_scale) * 10000 AS cost_drag_bps, avg(turnover) AS turnover FROM dd GROUP BY 1, 2""",
       "ann_return sharpe max_drawdown cost_drag_bps turnover cost_scale")
def _(spark, d):
    return evaluation.cost_sensitivity(ledger(spark, d)).select(
        "scenario", "cost_scale", "n_periods", "ann_return", "sharpe", "max_drawdown", "cost_drag_bps", "turnover")


@query("v8_longest_underwater", B.with_(LEDGER, """
e AS (SELECT *, product(1 + gross_return - cost) OVER (PARTITION BY scenario ORDER BY decision_session) AS eq FROM ledger),
u AS (SELECT *, eq / max(eq) OVER (PARTITION BY scenario ORDER BY decision_session) - 1 < -1e-9 AS under FROM e),
g AS (SELECT *, count(*) FILTER (NOT under) OVER (PARTITION BY scenario ORDER BY decision_session) AS run FROM u),
c AS (SELECT scenario, run, count(*) AS n FROM g WHERE under GROUP BY 1, 2)""") + """
SELECT scenario, coalesce(max(n), 0) AS max_drawdown_weeks FROM (SELECT DISTINCT scenario FROM ledger) LEFT JOIN c USING (scenario) GROUP BY 1""")
def _(spark, d):
    return performance.longest_underwater(performance.equity_path(ledger(spark, d)))


@query("v23_rolling_sharpe", B.with_(LEDGER) + """
SELECT scenario, decision_session, CASE WHEN count(*) OVER w >= 52 THEN avg(gross_return - cost) OVER w / nullif(stddev_samp(gross_return - cost) OVER w, 0) * sqrt(52.0)
  END AS rolling_sharpe FROM ledger WINDOW w AS (PARTITION BY scenario ORDER BY decision_session ROWS 51 PRECEDING)""", "rolling_sharpe")
def _(spark, d):
    return performance.rolling_series(ledger(spark, d)).select("scenario", "decision_session", "rolling_sharpe")


@query("b4_flat_weeks", """
WITH held AS (SELECT l_returnflag AS scenario, date_trunc('week', l_shipdate)::DATE AS w, count(*) AS n, sum(l_discount) AS gross FROM lineitem
              WHERE month(l_shipdate) <> 3 GROUP BY 1, 2),
paid AS (SELECT l_returnflag AS scenario, date_trunc('week', l_shipdate)::DATE AS w, avg(l_tax) AS cost FROM lineitem GROUP BY 1, 2)
SELECT scenario, w AS decision_session, coalesce(gross, 0) AS gross_return, cost, (coalesce(gross, 0) - cost) * sqrt(2.0) AS net_root2, coalesce(n, 0) AS n_positions
FROM paid LEFT JOIN held USING (scenario, w)""", "gross_return cost net_root2", 5)
def _(spark, d):
    """Books that are empty each March: those weeks stay, with the cost of that week."""
    li = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("scenario"), F.date_trunc("week", "l_shipdate").cast("date").alias("decision_session"),
                                               F.col("l_orderkey").cast("string").alias("o"), F.col("l_linenumber").alias("n"), F.month("l_shipdate").alias("m"),
                                               "l_discount", "l_tax", "l_suppkey", "l_partkey", "l_extendedprice")
    li = materialise(li.withColumn("ticker", F.concat_ws("-", "o", "n", "l_suppkey", "l_partkey", "l_extendedprice", "m")), "lines")
    one = li.groupBy("scenario", "decision_session", "ticker").agg(F.sum("l_discount").alias("forward_return"), F.count("*").alias("k"), F.max("m").alias("m"))
    held = one.filter("m <> 3")
    books = held.withColumn("weight", F.lit(1.0)).select("scenario", "decision_session", "ticker", "weight", "k").withColumn("k", F.explode(F.array_repeat(F.lit(1), F.col("k").cast("int"))))
    forward = one.select("decision_session", "ticker", "scenario", (F.col("forward_return") / F.col("k")).alias("forward_return"))
    paid = li.groupBy("scenario", "decision_session").agg(F.avg("l_tax").alias("total"), F.lit(0.0).alias("turnover"))
    named = F.concat_ws("|", "scenario", "ticker").alias("ticker")
    out = performance.weekly_ledger(books.select("scenario", "decision_session", named, "weight"), forward.select("decision_session", named, "forward_return"), paid,
                                    by=("scenario",))
    root2 = (F.col("net_return") * F.sqrt(F.lit(2.0))).alias("net_root2")  # sums of short decimals would tie when rounded
    return out.select("scenario", "decision_session", "gross_return", "cost", root2, "n_positions")


SCORES = """
scores AS (SELECT l_linenumber AS path, l_suppkey % 6 AS candidate, avg(l_discount) AS in_sample, avg(l_tax) AS out_of_sample FROM lineitem GROUP BY 1, 2)"""


def scores(spark, d):
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("path"), (F.col("l_suppkey") % 6).alias("candidate")).agg(
        F.avg("l_discount").alias("in_sample"), F.avg("l_tax").alias("out_of_sample"))


@query("v19_path_selections", B.with_(SCORES, """
r AS (SELECT *, rank() OVER (PARTITION BY path ORDER BY out_of_sample DESC) AS place FROM scores)""") + """
SELECT path, arg_max(candidate, in_sample) AS chosen, max(in_sample) AS in_sample, arg_max(out_of_sample, in_sample) AS out_of_sample,
       arg_max(place, in_sample)::INTEGER AS out_of_sample_place, count(*) AS n_candidates FROM r GROUP BY 1""", "in_sample out_of_sample")
def _(spark, d):
    return evaluation.path_selections(scores(spark, d))


@query("v14_overfitting_probability", B.with_(SCORES, """
p AS (SELECT path, arg_max(out_of_sample, in_sample) AS chosen, median(out_of_sample) AS mid FROM scores GROUP BY 1)""") + """
SELECT avg((chosen < mid)::INTEGER) AS pbo, count(*) AS n_paths FROM p""", "pbo")
def _(spark, d):
    return performance.overfitting_probability(scores(spark, d))


@query("m13_score_decision", B.with_(*FQ.MOM_BASE, FQ.LABELS, """
p AS (SELECT r.ticker, r.decision_session, l.label, l.label_t1 FROM raw r LEFT JOIN labels l USING (ticker, decision_session)),
t AS (SELECT ticker, avg(label) AS m FROM p WHERE label IS NOT NULL AND label_t1 < DATE '2001-01-12' GROUP BY 1)""") + """
SELECT p.ticker, coalesce(m, 0) AS prediction FROM p LEFT JOIN t USING (ticker) WHERE decision_session = DATE '2001-01-12'""", "prediction")
def _(spark, d):
    """Each name's mean label so far as its score at one decision: no label that closed later enters."""
    from tidemark.operators import labels

    bars, _, grid = FQ.setup(spark, d)
    panel = FQ._momentum_panel(spark, d).join(labels.build_labels(bars, grid), ["decision_session", "ticker"], "left")

    def fit(train):
        means = train.groupBy("ticker").agg(F.avg("label").alias("m"))
        return lambda df: df.join(means, "ticker", "left").withColumn("prediction", F.coalesce("m", F.lit(0.0)))

    return evaluation.score_decision(materialise(panel, "panel"), "2001-01-12", fit).select("ticker", "prediction")


@query("m8_block_contribution", B.with_(*FQ.MOM_BASE, """
n AS (SELECT ticker, decision_session, reversal_1w AS p, substr(ticker, 2)::BIGINT % 3 = 0 AS h, CASE WHEN substr(ticker, 2)::BIGINT % 3 = 0 THEN gap_1d END AS g
      FROM raw WHERE reversal_1w IS NOT NULL AND gap_1d IS NOT NULL),
k AS (SELECT h, (rank() OVER (PARTITION BY decision_session ORDER BY p) + (count(*) OVER (PARTITION BY decision_session, p) - 1) / 2.0)
               / count(*) OVER (PARTITION BY decision_session) AS pr,
        CASE WHEN g IS NOT NULL THEN (rank() OVER (PARTITION BY decision_session ORDER BY g NULLS LAST) + (count(*) OVER (PARTITION BY decision_session, g) - 1) / 2.0)
               / count(g) OVER (PARTITION BY decision_session) END AS nr FROM n),
s AS (SELECT 0.9 * stddev_pop(pr) AS a, 0.1 * stddev_pop(nr) * avg(h::INTEGER) AS b, avg(h::INTEGER) AS c FROM k)""") + """
SELECT a / (a + b) AS price, b / (a + b) AS news, c AS news_coverage FROM s""", "price news news_coverage")
def _(spark, d):
    p = FQ._momentum_panel(spark, d).filter("reversal_1w is not null and gap_1d is not null")
    p = p.withColumn("has_news", F.expr("cast(substring(ticker, 2, 20) as bigint) % 3 = 0"))
    return evaluation.block_contribution(p, price="reversal_1w", news="gap_1d")


@query("m4_zero_score", B.with_(*FQ.MOM_BASE) + " SELECT ticker, decision_session, 0.0::DOUBLE AS prediction FROM raw", "prediction")
def _(spark, d):
    fit = models.factory("zero", [])
    return fit(None)(FQ._momentum_panel(spark, d)).select("ticker", "decision_session", "prediction")


ORDER_ROWS = """
ords AS (SELECT l_suppkey::VARCHAR AS ticker, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice AS est_value FROM lineitem),
hold AS (SELECT s_suppkey::VARCHAR AS ticker, (s_suppkey % 50)::DOUBLE AS shares, 10.0::DOUBLE + s_suppkey % 7 AS price, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 7 * 25)::DOUBLE END AS lot_size FROM supplier)"""


def order_rows(spark, d):
    li, s = fx.table(spark, d, "lineitem"), fx.table(spark, d, "supplier")
    made = li.select(F.col("l_suppkey").cast("string").alias("ticker"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
                     F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("est_value"))
    k = F.col("s_suppkey")
    hold = s.select(k.cast("string").alias("ticker"), (k % 50).cast("double").alias("shares"), (F.lit(10.0) + k % 7).alias("price"),
                    F.when(k % 3 == 0, (k % 7 * 25).cast("double")).alias("lot_size"))
    return made, hold


@query("o2_summarise_orders", B.with_(ORDER_ROWS) + """
SELECT count(*) AS n_orders, sum(est_value) FILTER (side = 'buy') AS buy_value, sum(est_value) FILTER (side = 'sell') AS sell_value, sum(est_value) AS gross_value FROM ords""",
       "buy_value sell_value gross_value", 2)
def _(spark, d):
    return orders.summarise_orders(order_rows(spark, d)[0])


@query("o3_positions_after", B.with_(ORDER_ROWS) + """
SELECT ticker, sum(s) AS shares FROM (SELECT ticker, shares AS s FROM hold UNION ALL SELECT ticker, CASE side WHEN 'buy' THEN quantity ELSE -quantity END FROM ords)
GROUP BY 1 HAVING abs(sum(s)) > 1e-9""", "shares")
def _(spark, d):
    made, hold = order_rows(spark, d)
    return orders.positions_after(hold, made)


@query("o5_held_weights", B.with_(ORDER_ROWS) + " SELECT ticker, shares * price / 1e6 AS weight FROM hold", "weight", 9)
def _(spark, d):
    _, hold = order_rows(spark, d)
    return orders.held_weights(hold.select("ticker", "shares"), hold, 1e6)


@query("o6_capital_adequacy", B.with_(ORDER_ROWS) + """
SELECT ticker, lot_size, price, lot_size * price AS one_lot_notional, lot_size * price / 0.12 AS minimum_equity, lot_size * price <= 1e4 * 0.12 AS tradeable FROM hold WHERE lot_size > 1""",
       "lot_size price one_lot_notional minimum_equity", 4)
def _(spark, d):
    _, hold = order_rows(spark, d)
    return orders.capital_adequacy(hold.select("ticker", "lot_size"), hold, equity=1e4, max_weight=0.12)


def round_trip_sql() -> str:
    """Both legs of a cash trade of one million at a daily turnover of a hundred million."""
    f = costs.INDIA
    spread = "CASE WHEN rng > 0 THEN greatest(3.0, least(rng * 10000 * 0.02, 50.0)) ELSE 3.0 END * 1e-4"
    impact = "0.6 * vol / sqrt(252.0) * 10000 * sqrt(0.01) * 1e-4"
    fixed = f"2 * ({f.commission} + ({f.commission} + {f.exchange}) * {f.gst_rate} + {f.exchange}) * 1e-4"
    tax = f"({f.tax_buy} + {f.tax_sell} + {f.regulatory_sell} + {f.stamp}) * 1e-4"
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, ({fixed} + {tax} + 2 * ({spread} + {impact})) * 10000 AS round_trip_bps FROM (SELECT *, l_discount AS vol, l_tax AS rng FROM lineitem)"


@query("c6_round_trip", round_trip_sql(), "round_trip_bps l_extendedprice", 5)
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumns({"volatility": F.col("l_discount"), "hl_range": F.col("l_tax")})
    return costs.round_trip_bps(costs.INDIA, li).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "round_trip_bps")


SIX = 'ticker, session, open, high, low, "close", volume'


def six(bars):
    return bars.select("ticker", "session", "open", "high", "low", "close", "volume")


@query("s1_ticker_files", B.with_(B.BARS) + f" SELECT {SIX} FROM bars", "open high low close volume", 9)
def _(spark, d):
    """Bars as one CSV file for each ticker, read back by file name."""
    line = F.concat_ws(",", "session", "open", "high", "low", "close", "volume")
    path = fx.named_files(fx.bars(spark, d), "ticker", line, ".csv", scratch_path(spark, "named"), header="Date,O,High,L,C,Qty")
    return six(src.read_ticker_files(spark, path))


@query("s2_vendor_csv", B.with_(B.BARS) + f" SELECT {SIX} FROM bars", "open high low close volume", 9)
def _(spark, d):
    """The same in a vendor's layout, with a line that is no bar in each file."""
    line = F.concat_ws(",", "session", "open", "high", "low", "close", "volume")
    path = fx.named_files(fx.bars(spark, d), "ticker", line, ".us.txt", scratch_path(spark, "vendor"), header="Date,Open,High,Low,Close,Volume", last="Exceeded the daily limit")
    return six(src.read_vendor_csv(spark, path))


@query("s3_candles", B.with_(B.BARS) + f" SELECT {SIX} FROM bars", "open high low close volume", 9)
def _(spark, d):
    """Candle files: midnight of the session in local time."""
    candle = F.concat(F.lit('["'), "session", F.lit('T00:00:00+05:30",'), F.concat_ws(",", "open", "high", "low", "close", "volume"), F.lit(",0]"))
    whole = fx.bars(spark, d).groupBy("ticker").agg(F.concat_ws(",", F.collect_list(candle)).alias("c"))  # a file holds one ticker
    path = fx.named_files(whole, "ticker", F.concat(F.lit('{"data":{"candles":['), "c", F.lit("]}}")), ".json", scratch_path(spark, "candles"))
    return six(src.read_candles(spark, path))


@query("s4_charts", B.with_(B.BARS) + f" SELECT {SIX}, split_factor, div_cash FROM bars", "open high low close volume split_factor div_cash", 9)
def _(spark, d):
    """Chart files: parallel arrays, and splits and dividends as events."""
    at = F.unix_timestamp(F.col("session").cast("timestamp"))
    whole = fx.bars(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct(
        at.alias("t"), "open", "high", "low", "close", "volume", "split_factor", "div_cash"))).alias("r"))  # a file holds one ticker
    quote = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    events = lambda name, f: F.map_from_entries(F.transform(F.filter("r", lambda x: x[name] != (1.0 if name == "split_factor" else 0.0)),
                                                            lambda x: F.struct(x["t"].cast("string"), f(x))))
    splits = events("split_factor", lambda x: F.struct(x["t"].alias("date"), x["split_factor"].alias("numerator"), F.lit(1.0).alias("denominator")))
    dividends = events("div_cash", lambda x: F.struct(x["t"].alias("date"), x["div_cash"].alias("amount")))
    result = F.struct(F.col("r.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"),
                      F.struct(splits.alias("splits"), dividends.alias("dividends")).alias("events"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    path = fx.named_files(whole, "ticker", text, ".json", scratch_path(spark, "charts"))
    return src.read_charts(spark, path).select("ticker", "session", "open", "high", "low", "close", "volume", "split_factor", "div_cash")


@query("s8_universe_table", """
SELECT n_name AS ticker, arg_min(s_name, s_suppkey) AS name, 'Unknown' AS sector, arg_min((s_suppkey % 7 * 25)::DOUBLE, s_suppkey) AS lot_size
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""", "lot_size")
def _(spark, d):
    """A membership file with repeated tickers and without a sector column: the first row of a ticker wins."""
    s, n = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    raw = s.join(n, s.s_nationkey == n.n_nationkey).select(F.concat(F.lit(" "), "n_name").alias("Ticker"), F.col("s_name").alias("Name"),
                                                         (F.col("s_suppkey") % 7 * 25).cast("string").alias("lot_size"), F.col("s_suppkey").alias("file_order"))
    return tables.universe_table(raw).select("ticker", "name", "sector", "lot_size")


@query("r2_streamed_bars", B.with_(B.BARS) + f" SELECT {SIX} FROM bars", "open high low close volume", 9)
def _(spark, d):
    """Bars delivered twice, the second delivery last: the table after the stream is the bars."""
    bars = materialise(six(fx.bars(spark, d)), "bars")
    source, target = scratch_path(spark, "incoming"), scratch_path(spark, "bars")
    bars.filter("volume > 20").withColumn("close", F.col("close") + 1).write.parquet(f"{source}/day=1")
    bars.write.parquet(f"{source}/day=2")
    for day in (1, 2):
        stream = spark.readStream.schema(bars.schema).parquet(f"{source}/day={day}")
        run = stream.writeStream.foreachBatch(ingest.upsert_bars(spark, target)).option("checkpointLocation", f"{target}-log{day}").trigger(availableNow=True).start()
        run.awaitTermination()
    return six(ingest.read_bars(spark, target))


@query("r1_streamed_articles", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def _(spark, d):
    """Articles landed as files, each twice: a repeat of a ticker's text inside the watermark goes."""
    docs = fx.table(spark, d, "documents")
    first = docs.groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id"))
    rows = first.select(F.col("lang").alias("ticker"), F.lit("").alias("title"), F.concat(F.lit("."), "text").alias("body"), F.sha2("text", 256).alias("content_hash"),
                        F.col("doc_id").cast("string").alias("url"), F.lit("2024-01-01T00:00:00Z").alias("published_at"))
    source, target = scratch_path(spark, "articles"), scratch_path(spark, "kept")
    rows.write.json(source)
    rows.write.mode("append").json(source)
    run = ingest.article_stream(spark, source).writeStream.format("parquet").option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start(target)
    run.awaitTermination()
    return spark.read.parquet(target).select(F.col("url").cast("bigint").alias("doc_id"))
