"""Cleaning, visibility, calendar and universe queries."""

from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import clean, universe, visibility
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog.registry import query
from tidemark.sources import fixtures as fx

BAR_DOUBLES = "open high low close volume split_factor div_cash"
AT = "epoch(available_at)::BIGINT AS available_epoch"


def _epoch(c):
    return F.unix_timestamp(c).alias("available_epoch")


@query("d1_canonical_bars", B.with_(B.BARS) + f"""
SELECT ticker, session, open, high, low, "close", volume, split_factor, div_cash, {AT}, is_delisted FROM bars""",
       BAR_DOUBLES, 9)
def _(spark, d):
    """Two overlapping loads: the later one wins, missing columns take their defaults."""
    bars = fx.bars(spark, d)
    stale = bars.withColumn("close", F.col("close") * 2.0).drop("split_factor", "is_delisted")
    both = stale.withColumn("batch", F.lit(1)).unionByName(
        bars.withColumn("batch", F.lit(2)), allowMissingColumns=True)
    out = clean.canonical_bars(both, order_by="batch")
    return out.select("*", _epoch("available_at")).drop("available_at")


@query("d2_screen_bars", B.with_(B.BARS, """
sound AS (SELECT *, abs(ln("close") - lag(ln("close")) OVER (PARTITION BY ticker ORDER BY session)) AS move FROM bars
          WHERE open > 0 AND high > 0 AND low > 0 AND "close" > 0 AND high >= low
            AND "close" BETWEEN low * 0.999 AND high * 1.001)""") + """
SELECT ticker, session, "close" FROM sound WHERE NOT coalesce(move > ln(1.6) AND split_factor = 1.0, FALSE)""",
       "close", 9)
def _(spark, d):
    return clean.screen_bars(fx.bars(spark, d)).select("ticker", "session", "close")


@query("d3_liquidity", B.with_(B.BARS, """
w AS (SELECT *, count("close" * volume) OVER r AS n, avg("close" * volume) OVER r AS m FROM bars
      WINDOW r AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""") + """
SELECT ticker, session, CASE WHEN n >= 5 THEN m END AS adv_notional,
       "close" >= 500 AND coalesce(CASE WHEN n >= 5 THEN m END, 0) >= 200000 AS liquid FROM w""", "adv_notional", 1)
def _(spark, d):
    return clean.liquidity(fx.bars(spark, d), min_price=500.0, min_adv=200_000.0).select(
        "ticker", "session", "adv_notional", "liquid")


@query("d4_liquidity_eligible", B.with_(B.BARS) + """
SELECT ticker, session, "close" >= 1000 AND "close" * volume >= 100000 AS eligible FROM bars""")
def _(spark, d):
    bars = fx.bars(spark, d).withColumn("adv_notional", F.col("close") * F.col("volume"))
    return clean.liquidity_eligible(bars, min_price=1000.0, min_adv=100_000.0).select("ticker", "session", "eligible")


ADJUST_SQL = """
steps AS (
  SELECT *, (1.0::DOUBLE / CASE WHEN s > 0 THEN s ELSE 1 END)
            * (1 - least(greatest(CASE WHEN "close" > 0 THEN v / "close" ELSE 0 END, 0), 0.95)) AS step
  FROM (SELECT *, CASE WHEN {known} THEN split_factor ELSE 1.0::DOUBLE END AS s,
                  CASE WHEN {known} THEN div_cash ELSE 0.0::DOUBLE END AS v FROM bars)),
adj AS (SELECT *, coalesce(product(step) OVER (PARTITION BY ticker ORDER BY session DESC
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS f FROM steps)"""
ADJUST_OUT = """
SELECT ticker, session, ln(open * f) AS open, ln(high * f) AS high, ln(low * f) AS low, ln("close" * f) AS "close",
       ln(volume / f) AS volume, f AS adjustment_factor FROM adj"""


def _log_adjusted(df):
    """Adjusted prices are compared as logarithms: products of short decimals would tie when rounded."""
    return df.select("ticker", "session", *[F.ln(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
                     "adjustment_factor")


@query("d5_adjust_asof", B.with_(B.BARS, ADJUST_SQL.format(known="session <= DATE '2000-12-29'")) + ADJUST_OUT,
       "open high low close volume adjustment_factor", 8)
def _(spark, d):
    from datetime import date
    return _log_adjusted(clean.adjust_asof(fx.bars(spark, d), date(2000, 12, 29)))


@query("d5_adjust_full", B.with_(B.BARS, ADJUST_SQL.format(known="TRUE")) + ADJUST_OUT,
       "open high low close volume adjustment_factor", 8)
def _(spark, d):
    return _log_adjusted(clean.adjust_asof(fx.bars(spark, d)))


@query("d6_total_return", B.with_(B.BARS) + """
SELECT ticker, session, ("close" + div_cash) / ((lag("close") OVER (PARTITION BY ticker ORDER BY session)) / split_factor)
       - 1 AS total_return FROM bars""", "total_return")
def _(spark, d):
    return clean.total_return(fx.bars(spark, d)).select("ticker", "session", "total_return")


@query("d7_delisting_returns", B.with_(B.BARS, B.SESSIONS, B.MEMBERSHIP, """
hit AS (SELECT session, sum(0.05::DOUBLE) * -0.3 AS impact FROM
        (SELECT ticker, end_date AS session FROM universe WHERE end_date IS NOT NULL) JOIN sessions USING (session)
        GROUP BY session)""") + """
SELECT session, 1.0::DOUBLE * product(1 + coalesce(impact, 0)) OVER (ORDER BY session) AS equity
FROM sessions LEFT JOIN hit USING (session)""", "equity", 9)
def _(spark, d):
    sessions = cal.sessions(fx.bars(spark, d))
    gone = universe.delisting_returns(fx.membership(spark, d)).select("ticker", "session")
    weights = gone.join(sessions, "session").select("ticker", "session", F.lit(0.05).alias("weight"))
    curve = sessions.select("session", F.lit(1.0).alias("equity"))
    return clean.apply_delisting_returns(curve, gone, weights, -0.3)


@query("d8_visible_bars", B.with_(B.BARS) + """
SELECT ticker, count(*) AS n_visible, max(session) AS last_session FROM bars
WHERE available_at <= TIMESTAMP '2000-09-01 21:00:00' GROUP BY ticker""")
def _(spark, d):
    seen = visibility.visible_bars(fx.bars(spark, d), "2000-09-01 21:00:00")
    return seen.groupBy("ticker").agg(F.count("*").alias("n_visible"), F.max("session").alias("last_session"))


@query("d8_visible_news", """
SELECT 'U' || user_id % 20 AS ticker, count(*) AS n_visible FROM events
WHERE ts < (SELECT ts FROM events WHERE event_id = 5000) GROUP BY 1""")
def _(spark, d):
    cut = fx.table(spark, d, "events").filter("event_id = 5000").select(F.col("ts").cast("timestamp").alias("cut"))
    news = fx.analyses(spark, d).crossJoin(F.broadcast(cut))  # one row
    return visibility.visible_news(news, F.col("cut")).groupBy("ticker").agg(F.count("*").alias("n_visible"))


@query("d9_truncate_sessions", B.with_(B.BARS) + """
SELECT ticker, count(*) AS n, max(session) AS last_session FROM bars WHERE session <= DATE '2000-06-30' GROUP BY 1""")
def _(spark, d):
    return visibility.truncate_sessions(fx.bars(spark, d), "2000-06-30").groupBy("ticker").agg(
        F.count("*").alias("n"), F.max("session").alias("last_session"))


@query("d10_pit_report", B.with_(B.BARS) + """
SELECT 'bars' AS frame, count(*) FILTER (available_at > TIMESTAMP '2001-01-01') AS n_late,
       epoch(max(available_at) FILTER (available_at > TIMESTAMP '2001-01-01'))::BIGINT AS worst FROM bars
UNION ALL
SELECT 'news', count(*) FILTER (ts > TIMESTAMP '2001-01-01'),
       CAST(floor(epoch(max(ts) FILTER (ts > TIMESTAMP '2001-01-01'))) AS BIGINT) FROM events""")
def _(spark, d):
    report = visibility.pit_report({"bars": fx.bars(spark, d), "news": fx.analyses(spark, d)}, "2001-01-01")
    return report.withColumn("worst", F.unix_timestamp("worst"))


@query("d11_ensure_utc", """
SELECT event_id, CAST(floor(epoch(timezone('America/New_York', ts))) AS BIGINT) AS at FROM events""")
def _(spark, d):
    ev = visibility.ensure_utc(fx.table(spark, d, "events"), "ts", "America/New_York")
    return ev.select("event_id", F.unix_timestamp("ts").alias("at"))


@query("d12_decision_sessions", B.with_(B.BARS, B.SESSIONS, B.decisions()) + " SELECT * FROM decisions")
def _(spark, d):
    return cal.decision_sessions(cal.sessions(fx.bars(spark, d)))


@query("d12_decision_sessions_wed", B.with_(B.BARS, B.SESSIONS, B.decisions(2)) + " SELECT * FROM decisions")
def _(spark, d):
    return cal.decision_sessions(cal.sessions(fx.bars(spark, d)), weekday=2)


@query("d13_weekly_grid", B.with_(B.BARS, B.SESSIONS, B.decisions(), B.grid()) + """
SELECT decision_session, epoch(timezone('America/New_York', CAST(decision_session AS TIMESTAMP) + INTERVAL 16 HOUR))::BIGINT
       AS decision_epoch, entry_session, exit_session FROM grid""")
def _(spark, d):
    grid = cal.weekly_grid(cal.sessions(fx.bars(spark, d)))
    return grid.select("decision_session", F.unix_timestamp("decision_ts").alias("decision_epoch"),
                       "entry_session", "exit_session")


@query("d14_shift_sessions", B.with_(B.BARS, B.SESSIONS, """
days AS (SELECT DISTINCT DATE '1999-12-20' + CAST(s_suppkey * 7 AS INTEGER) AS day FROM supplier),
seen AS (SELECT day, (SELECT count(*) FROM sessions WHERE session <= day) AS upto,
              (SELECT count(*) FROM sessions WHERE session < day) AS before FROM days)""") + """
SELECT day AS "date", n.session AS next_session, p.session AS prev_session FROM seen
LEFT JOIN sessions n ON n.position = upto + 3 LEFT JOIN sessions p ON p.position = before - 3 + 1""")
def _(spark, d):
    dates = fx.table(spark, d, "supplier").select(
        F.date_add(F.lit("1999-12-20").cast("date"), (F.col("s_suppkey") * 7).cast("int")).alias("date")).distinct()
    return cal.shift_sessions(dates, cal.sessions(fx.bars(spark, d)), "date", 3)


@query("d14_sessions_between", B.with_(B.BARS, B.SESSIONS) + """
SELECT session FROM sessions WHERE session BETWEEN DATE '2000-03-04' AND DATE '2000-05-13'""")
def _(spark, d):
    return cal.sessions_between(cal.sessions(fx.bars(spark, d)), "2000-03-04", "2000-05-13").select("session")


@query("d15_decision_for", B.with_(B.BARS, B.SESSIONS, B.decisions(), B.grid()) + """
SELECT 'asof' AS which, * FROM (SELECT * FROM grid WHERE decision_session <= DATE '2000-08-09'
                                ORDER BY decision_session DESC LIMIT 1)
UNION ALL
SELECT 'latest', * FROM (SELECT decision_session, entry_session, coalesce(exit_session, (SELECT max(session) FROM sessions))
                         FROM decisions JOIN placed ON session = decision_session WHERE entry_session IS NOT NULL
                         ORDER BY decision_session DESC LIMIT 1)""")
def _(spark, d):
    sessions = cal.sessions(fx.bars(spark, d))
    keep = ("which", "decision_session", "entry_session", "exit_session")
    asof = cal.decision_for(sessions, "2000-08-09").withColumn("which", F.lit("asof")).select(*keep)
    return asof.unionByName(cal.latest_decision(sessions).withColumn("which", F.lit("latest")).select(*keep))


WEEKLY_SQL = """
ends AS (SELECT session, min(decision_session) OVER (ORDER BY session DESC ROWS UNBOUNDED PRECEDING) AS week_end
         FROM sessions LEFT JOIN decisions ON decision_session = session),
weekly AS (
  SELECT ticker, week_end AS session, arg_min(open, session) AS open, max(high) AS high, min(low) AS low,
         arg_max("close", session) AS "close", sum(volume) AS volume, product(split_factor) AS split_factor,
         sum(div_cash) AS div_cash, max(available_at) AS available_at, count(*) AS n_sessions
  FROM bars JOIN ends USING (session) WHERE week_end IS NOT NULL GROUP BY ticker, week_end)"""


@query("d16_weekly_bars", B.with_(B.BARS, B.SESSIONS, B.decisions(), WEEKLY_SQL) + f"""
SELECT ticker, session, open, high, low, "close", volume, split_factor, div_cash, {AT}, n_sessions FROM weekly""",
       BAR_DOUBLES, 9)
def _(spark, d):
    return cal.to_weekly(fx.bars(spark, d)).select("*", _epoch("available_at")).drop("available_at")


@query("d17_weekly_returns", B.with_(B.BARS, B.SESSIONS, B.decisions(), WEEKLY_SQL) + """
SELECT ticker, session, ln("close") - lag(ln("close")) OVER (PARTITION BY ticker ORDER BY session) AS weekly_log_return
FROM weekly""", "weekly_log_return")
def _(spark, d):
    return cal.weekly_returns(cal.to_weekly(fx.bars(spark, d))).select("ticker", "session", "weekly_log_return")


@query("d18_align_panel", B.with_(B.BARS, B.SESSIONS) + """
SELECT t.ticker, s.session, "close" FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN sessions s
LEFT JOIN bars b ON b.ticker = t.ticker AND b.session = s.session""", "close", 9)
def _(spark, d):
    bars = fx.bars(spark, d)
    return cal.align_panel(bars.select("ticker", "session", "close"), cal.sessions(bars), bars)


@query("d19_members_asof", B.with_(B.MEMBERSHIP) + """
SELECT ticker, name, sector FROM universe
WHERE start_date <= DATE '2000-03-01' AND (end_date IS NULL OR end_date >= DATE '2000-03-01')""")
def _(spark, d):
    return universe.members_asof(fx.membership(spark, d), "2000-03-01")


@query("d19_first_members", B.with_(B.MEMBERSHIP) + """
SELECT ticker, name, sector FROM universe
WHERE start_date <= DATE '2000-03-01' AND (end_date IS NULL OR end_date >= DATE '2000-03-01')
ORDER BY file_order LIMIT 40""")
def _(spark, d):
    """A universe that is defined as its first names in file order."""
    return universe.members_asof(fx.membership(spark, d), "2000-03-01", max_names=40)


@query("d20_membership_panel", B.with_(B.BARS, B.SESSIONS, B.MEMBERSHIP) + """
SELECT session, ticker, sector FROM sessions JOIN universe
ON session >= start_date AND session <= coalesce(end_date, DATE '9999-12-31')""")
def _(spark, d):
    return universe.membership_panel(fx.membership(spark, d), cal.sessions(fx.bars(spark, d)))


@query("d21_universe_attributes", B.with_(B.MEMBERSHIP) + """
SELECT ticker, sector, CASE WHEN lot_size > 1 THEN lot_size::INTEGER END AS lot_size, end_date AS exit_session,
       CASE WHEN end_date IS NOT NULL THEN coalesce(delisting_return, -0.3::DOUBLE) END AS delisting_return
FROM universe""", "delisting_return")
def _(spark, d):
    u = fx.membership(spark, d)
    gone = universe.delisting_returns(u).withColumnRenamed("session", "exit_session")
    return universe.sectors(u).join(universe.lot_sizes(u), "ticker", "left").join(gone, "ticker", "left")


@query("d22_survivorship_check", B.with_(B.MEMBERSHIP) + """
SELECT count(*) AS n_names, count(end_date) AS n_exits,
       count(end_date) < greatest(1, CAST(floor(count(*) * 0.05) AS INTEGER)) AS is_biased FROM universe""")
def _(spark, d):
    return universe.survivorship_check(fx.membership(spark, d)).drop("warning")
