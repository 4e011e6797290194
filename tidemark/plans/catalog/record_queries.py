"""Sinks read back, feeds, order costs, fills left out, verdict rules, risk-scaled books, eligibility."""

from pyspark.sql import functions as F

from tidemark.operators import book, costs, evaluation, fills, performance, universe
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import evaluation_queries as EQ
from tidemark.plans.catalog import money_queries as MQ
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise, scratch_path
from tidemark.sources import fixtures as fx
from tidemark.sources import tables


@query("s14_bars_csv", B.with_(B.BARS) + f" SELECT {EQ.SIX} FROM bars", "open high low close volume", 9)
def _(spark, d):
    """Bars written by ticker as CSV, in two appends, and read back."""
    path, bars = scratch_path(spark, "bars-csv"), materialise(EQ.six(fx.bars(spark, d)), "bars")
    tables.write_bars_csv(bars.filter("volume > 20"), path)
    tables.write_bars_csv(bars.filter("volume <= 20"), path)
    return EQ.six(spark.read.option("header", True).schema("session date, open double, high double, low double, close double, volume double, ticker string").csv(path))


@query("s15_records", """
SELECT doc_id, lang AS ticker, n_chars, 'articles' AS sink FROM documents UNION ALL SELECT doc_id, lang, n_chars, 'blotter' FROM documents""")
def _(spark, d):
    """Articles as JSON lines and a blotter as CSV, each appended twice, read back."""
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("lang").alias("ticker"), "n_chars")
    out = None
    for name, write, read in (("articles", tables.write_articles, lambda p: spark.read.schema(docs.schema).json(p)),
                              ("blotter", tables.append_csv, lambda p: spark.read.option("header", True).schema(docs.schema).csv(p))):
        path = scratch_path(spark, name)
        write(docs.filter("doc_id % 2 = 0"), path)
        write(docs.filter("doc_id % 2 = 1"), path)
        back = read(path).withColumn("sink", F.lit(name))
        out = back if out is None else out.union(back)
    return out


@query("s6_feed", """
SELECT lang AS ticker, 'Report ' || doc_id AS title, 'Body & more ' || n_chars AS body, 'http://feed.example/' || doc_id AS url, source,
       TIMESTAMP '2024-03-01' + to_minutes(doc_id % 40000) AS published_at FROM documents""")
def _(spark, d):
    """Feeds as one file for each ticker: titles that end in the source, markup and entities in the text."""
    docs = fx.table(spark, d, "documents")
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-03-01").cast("timestamp")) + F.col("doc_id") % 40000 * 60_000_000)
    item = F.concat(F.lit("<item><title>Report "), "doc_id", F.lit(" - "), "source", F.lit("</title><link>http://feed.example/"), "doc_id", F.lit("</link><pubDate>"),
                    F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>&lt;b&gt;Body&lt;/b&gt; &amp;amp; more "), "n_chars", F.lit("</description><source>"), "source", F.lit("</source></item>"))
    path = fx.named_files(docs, "lang", item, ".xml", scratch_path(spark, "feed"), header="<rss><channel>", last="</channel></rss>")
    out = tables.read_feed(spark, path, "2024-06-01 00:00:00")
    return out.select("ticker", "title", F.regexp_replace("body", " +", " ").alias("body"), "url", "source", "published_at")


SLIP = costs.INDIA


@query("c7_expected_slippage", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_extendedprice > 0 THEN
  CASE WHEN s_suppkey IS NOT NULL AND (s_suppkey % 9) > 0 THEN greatest({SLIP.min_half_spread}::DOUBLE, least(s_suppkey % 9 / 1000.0::DOUBLE * 10000 * {SLIP.spread_from_range}, 50)) ELSE {SLIP.min_half_spread} END
  + {SLIP.impact_k} * 0.3 / sqrt(252.0) * 10000 * sqrt(least(l_extendedprice / (1e6 + 1e5 * (s_suppkey % 7)), 1)) END AS expected_slip_bps
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""", "expected_slip_bps l_extendedprice", 4)
def _(spark, d):
    """Spread and impact expected of every line as an order; the volatility is not known."""
    li, s = fx.table(spark, d, "lineitem"), fx.table(spark, d, "supplier")
    made = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_extendedprice").alias("est_value"),
                     F.lit("buy").alias("side"), F.lit("equity").alias("instrument"))
    k = F.col("s_suppkey")
    stats = s.select(k.cast("string").alias("ticker"), F.lit(None).cast("double").alias("volatility"), (1e6 + 1e5 * (k % 7)).alias("adv_notional"), (k % 9 / 1000.0).alias("hl_range"))
    return costs.expected_slippage(made, stats, SLIP).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "expected_slip_bps")


@query("c4_holding_cost", f"""
SELECT l_suppkey, ln(1 + sum(greatest(n, 0)) * {SLIP.borrow_annual} * 1e-4 / 252 * 25) AS borrow, ln(1 + sum(greatest(n, 0)) * {SLIP.futures_roll} * 1e-4 * 2) AS roll
FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE -l_extendedprice END AS n FROM lineitem) GROUP BY 1""", "borrow roll", 8)
def _(spark, d):
    """Borrow and roll of short notionals held for 25 sessions and two rolls; long ones cost nothing."""
    li = fx.table(spark, d, "lineitem").withColumn("n", F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")))
    held = costs.holding_cost("n", 25, 2, SLIP)
    return li.withColumns(held).groupBy("l_suppkey").agg(F.log1p(F.sum("borrow")).alias("borrow"), F.log1p(F.sum("roll")).alias("roll"))


@query("t2_fills_left_out", """
WITH f AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 4 THEN 0.0::DOUBLE WHEN l_linenumber = 5 THEN -l_quantity ELSE l_quantity END AS q,
             CASE WHEN l_linenumber = 3 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS ref, CASE WHEN l_linenumber = 6 THEN 130.0 ELSE 100 + l_tax * 10 END AS price FROM lineitem WHERE l_linenumber <> 7),
o AS (SELECT * FROM f WHERE l_linenumber <> 2)
SELECT coalesce(CASE WHEN o.id IS NULL THEN 'unattributed' WHEN o.ref <= 0 THEN 'no reference' WHEN CASE WHEN f.q = 0 THEN o.l_quantity ELSE f.q END <= 0 THEN 'zero quantity'
         WHEN abs((f.price - o.ref) / o.ref * 10000) > 2000 THEN 'implausible' END, 'used') AS dropped, count(*) AS n, sum(f.price * CASE WHEN f.q = 0 THEN o.l_quantity ELSE f.q END) AS notional
FROM f LEFT JOIN (SELECT DISTINCT id, ref, l_quantity, l_suppkey, l_partkey, l_extendedprice FROM o) o
  ON f.id = o.id AND f.l_suppkey = o.l_suppkey AND f.l_partkey = o.l_partkey AND f.l_extendedprice = o.l_extendedprice GROUP BY 1""", "notional", 2)
def _(spark, d):
    """Fills of every kind that is left out: unknown orders, no reference, a negative quantity, a price far off; a zero quantity takes the order's."""
    li = fx.table(spark, d, "lineitem").filter("l_linenumber <> 7")
    n = F.col("l_linenumber")
    rows = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("client_order_id"), n.alias("n"), "l_quantity",
                     F.when(n == 4, 0.0).when(n == 5, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("q"), F.when(n == 3, 0.0).otherwise(100.0).alias("est_price"),
                     F.when(n == 6, 130.0).otherwise(100 + F.col("l_tax") * 10).alias("price"))
    asked = rows.filter("n <> 2").select("client_order_id", F.lit("buy").alias("side"), "est_price", F.col("l_quantity").alias("quantity"), F.lit(5.0).alias("expected_slip_bps")).distinct()
    judged = fills.judge_fills(rows.select("client_order_id", "price", F.col("q").alias("quantity")), asked)
    return judged.groupBy(F.coalesce("dropped", F.lit("used")).alias("dropped")).agg(F.count("*").alias("n"), F.sum("notional").alias("notional"))


NAMES = ("shuffled", "momentum", "random", "benchmark", "price_news")


@query("v21_verdicts", f"""
WITH s AS (SELECT list_extract({list(NAMES)}, l_linenumber::INTEGER) AS scenario, avg(l_discount) * 10 AS sharpe, avg(l_tax) AS ic, avg(l_quantity) / 10 AS ic_t FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1),
r AS (SELECT max(sharpe) FILTER (scenario = 'momentum') AS m, max(sharpe) FILTER (scenario = 'random') AS r, max(sharpe) FILTER (scenario = 'benchmark') AS b, max(sharpe) FILTER (scenario = 'price_news') AS p,
        max(ic) FILTER (scenario = 'shuffled') AS i, max(ic_t) FILTER (scenario = 'shuffled') AS t FROM s)
SELECT 'no_leak' AS rule, NOT (i > 0.005 AND t > 2.5) AS holds, i AS value, 0.005::DOUBLE AS against FROM r UNION ALL SELECT 'beats_momentum', p > m, p, m FROM r
UNION ALL SELECT 'random_is_poor', r <= 0.2, r, 0.2 FROM r UNION ALL SELECT 'news_adds', 0.04 < 0.05 AND 0.1 > 0, 0.1, 0.04 FROM r UNION ALL SELECT 'beats_benchmark', p > b, p, b FROM r""", "value against", 8)
def _(spark, d):
    """The verdict rules over a summary row for each line number."""
    li = fx.table(spark, d, "lineitem").filter("l_linenumber <= 5")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber").cast("int"))
    summary = li.groupBy(name.alias("scenario")).agg((F.avg("l_discount") * 10).alias("sharpe"), F.avg("l_tax").alias("ic"), (F.avg("l_quantity") / 10).alias("ic_t"))
    test = spark.range(1).select(F.lit(0.1).alias("difference"), F.lit(0.04).alias("p_value"))
    return evaluation.verdicts(summary, test)


RISK = "CASE week(decision_session) % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


@query("p15_risk_scaled_book", B.with_(*MQ.BASE, MQ.PICK, MQ.STATS, MQ.INVVOL, B.MEMBERSHIP, f"""
risky AS (SELECT decision_session, ticker, weight * {RISK} AS weight FROM weighted WHERE {RISK} > 0)""", *[c.replace("FROM weighted JOIN", "FROM risky JOIN") for c in MQ._limit_sql()]) + """
SELECT decision_session, ticker, weight, CASE WHEN weight >= 0 THEN 'equity' ELSE 'futures' END AS instrument, CASE WHEN weight < 0 THEN 'short' ELSE 'long' END AS side
FROM limited WHERE abs(weight) > 1e-9""", "weight", 7)
def _(spark, d):
    """Selection, inverse volatility, a risk scale for each week (zero every third), limits."""
    s, bars, _ = MQ.scores(spark, d)
    stats = performance.trailing_stats(bars).withColumnRenamed("session", "decision_session")
    s = s.join(stats, ["decision_session", "ticker"], "left").join(universe.sectors(fx.membership(spark, d)), "ticker", "left")
    week = F.weekofyear("decision_session") % 3
    risk = s.select("decision_session").distinct().withColumn("risk_scale", F.when(week == 0, 0.0).when(week == 1, 0.5).otherwise(1.0))
    out = book.build_book(s, risk_scale=risk, target_vol=0.0, short_instrument="futures")
    return out.select("decision_session", "ticker", "weight", "instrument", "side")


@query("b3_eligibility", B.with_(B.BARS) + """
SELECT ticker, session AS decision_session, volume > 60 AND isodow(session) <> 3 AS liquid FROM bars WHERE isodow(session) IN (3, 5)""")
def _(spark, d):
    """Liquid flags at decisions; on Wednesdays no name has a flag."""
    bars = fx.bars(spark, d)
    flags = bars.filter(F.dayofweek("session") != 4).select("session", "ticker", (F.col("volume") > 60).alias("liquid"))
    keys = bars.filter(F.dayofweek("session").isin(4, 6)).select("ticker", F.col("session").alias("decision_session"))
    return performance.eligibility_at(keys, flags).select("ticker", "decision_session", "liquid")
