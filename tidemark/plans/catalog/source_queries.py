"""Source, model and streaming queries."""

from pyspark.sql import functions as F

from tidemark.operators import features, models
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import feature_queries as FQ
from tidemark.plans.catalog import feature_sql as FS
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise, scratch_path
from tidemark.sources import bars as src
from tidemark.sources import fixtures as fx
from tidemark.sources import tables
from tidemark.streaming import ingest

SIX = 'ticker, session, open, high, low, "close", volume'


@query("s1_csv_bars", B.with_(B.BARS) + f" SELECT {SIX} FROM bars WHERE session >= DATE '2000-02-01'", "open high low close volume", 9)
def _(spark, d):
    """Bars written as CSV under other header names, then read back."""
    path = scratch_path(spark, "csv")
    out = fx.bars(spark, d).select(F.concat("ticker", F.lit(".csv")).alias("f"), "ticker", F.col("session").alias("Date"), F.col("open").alias("O"),
                                   F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"), F.col("volume").alias("Qty"))
    out.drop("f").write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)
    bars = src._finish(src._rename(raw), "2000-02-01", "2999-12-31", 21)
    return bars.select("ticker", "session", "open", "high", "low", "close", "volume")


@query("s5_articles_jsonl", """
SELECT doc_id, lang AS ticker, length(text) > 0 AS has_text, epoch(TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10))::BIGINT AS at
FROM documents WHERE doc_id % 10 <> 3""")
def _(spark, d):
    """Articles landed as JSON Lines, one in ten with a date that does not parse, half with epoch seconds."""
    arts = fx.articles(spark, d)
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.when(F.col("doc_id") % 10 == 3, "not a date").when(F.col("doc_id") % 2 == 0, F.unix_timestamp("published_at").cast("string")).otherwise(iso)
    path = scratch_path(spark, "jsonl")
    arts.select("ticker", F.lit("").alias("title"), F.concat(F.lit("."), "title", "body").alias("body"), F.col("doc_id").cast("string").alias("url"),
                "source", stamp.alias("published_at")).write.json(path)
    out = tables.read_articles(spark, path)
    return out.select(F.col("url").cast("bigint").alias("doc_id"), "ticker", (F.length("body") > 0).alias("has_text"),
                      F.unix_timestamp("available_at").alias("at"))


@query("s7_instrument_snapshot", """
SELECT CAST(p_partkey AS VARCHAR) AS ticker, coalesce(arg_min(CAST(l_quantity AS INTEGER), (l_orderkey * 64 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)), 0) AS lot_size
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, d):
    li, part = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    expiry = (F.col("l_orderkey") * 64 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("bigint")
    fut = li.select(F.lit("NSE_FO").alias("segment"), F.lit("FUT").alias("instrument_type"), F.col("l_partkey").cast("string").alias("asset_symbol"),
                    expiry.alias("expiry"), F.col("l_quantity").cast("int").alias("lot_size"))
    eq = part.select(F.lit("NSE_EQ").alias("segment"), F.lit("EQ").alias("instrument_type"), F.col("p_partkey").cast("string").alias("trading_symbol"),
                     F.col("p_name").alias("name"), F.lit(None).cast("string").alias("isin"), F.lit(None).cast("string").alias("instrument_key"),
                     F.lit(None).cast("int").alias("freeze_quantity"))
    return tables.instrument_snapshot(eq.unionByName(fut, allowMissingColumns=True)).select("ticker", "lot_size")


@query("s9_source_precedence", B.with_(B.BARS) + """
SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'csv' ELSE 'vendor' END AS source, count(*) AS n_bars FROM bars GROUP BY 1""")
def _(spark, d):
    bars = fx.bars(spark, d)
    chosen, names = src.by_precedence({"csv": bars.filter("cast(substring(ticker, 2, 20) as bigint) % 3 = 0"), "vendor": bars})
    return chosen.join(names, "ticker").groupBy("source").agg(F.count("*").alias("n_bars"))


@query("s10_covered_tickers", B.with_(B.BARS) + """
SELECT ticker FROM bars GROUP BY 1 HAVING min(session) <= DATE '2000-01-10' AND max(session) >= DATE '2001-05-04'""")
def _(spark, d):
    return tables.covered_tickers(fx.bars(spark, d), "2000-01-03", "2001-05-11")


@query("s11_s12_provenance", """
SELECT count(*) AS n_tickers, count(*) FILTER (s_suppkey % 9 = 0) AS n_fabricated, count(*) FILTER (s_suppkey % 9 <> 0) AS n_real FROM supplier""")
def _(spark, d):
    s = fx.table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").cast("string").alias("ticker"), F.when(F.col("s_suppkey") % 9 == 0, "synthetic").otherwise("csv").alias("source"))
    new = s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("ticker"), F.lit("cache").alias("source"))
    return tables.provenance_summary(tables.merge_attribution(old, new)).drop("verdict")


@query("s13_upsert", B.with_(B.BARS) + """
SELECT ticker, session, CASE WHEN volume > 20 THEN volume * 2 ELSE volume END AS volume FROM bars""")
def _(spark, d):
    bars = fx.bars(spark, d).select("ticker", "session", "volume")
    return tables.upsert(bars, bars.filter("volume > 20").withColumn("volume", F.col("volume") * 2), ["ticker", "session"])


@query("m3_momentum_score", B.with_(B.BARS, B.SESSIONS, B.decisions(), B.grid(), FS.LEVEL_0, f"""
mom AS (SELECT ticker, session AS decision_session, {FS.COLUMNS['reversal_1w']} AS a, {FS.COLUMNS['mom_12w']} AS b, {FS.COLUMNS['mom_52w_skip4w']} AS c FROM f0)""") + """
SELECT ticker, decision_session, 0.5 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.2 * coalesce(c, 0) AS prediction FROM mom JOIN grid USING (decision_session)""", "prediction")
def _(spark, d):
    """All three factors, on every decision row."""
    bars, _, grid = FQ.setup(spark, d)
    panel = features.price_features(bars, grid.select(F.col("decision_session").alias("session")), blocks=("price",)).withColumnRenamed("session", "decision_session")
    return models.momentum_score(panel).select("ticker", "decision_session", "prediction")


@query("m7_blend_scores", B.with_(*FQ.MOM_BASE, """
n AS (SELECT ticker, decision_session, reversal_1w AS p, CASE WHEN substr(ticker, 2)::BIGINT % 3 = 0 THEN gap_1d END AS g,
        substr(ticker, 2)::BIGINT % 3 = 0 AS h FROM raw WHERE reversal_1w IS NOT NULL AND gap_1d IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY decision_session ORDER BY p) / count(*) OVER (PARTITION BY decision_session)::DOUBLE - 0.5 AS pr,
        rank() OVER (PARTITION BY decision_session ORDER BY g NULLS LAST) / count(g) OVER (PARTITION BY decision_session)::DOUBLE - 0.5 AS nr FROM n)""") + """
SELECT ticker, decision_session, CASE WHEN h THEN 0.9 * pr + 0.1 * nr ELSE pr END AS prediction FROM k""", "prediction", 5)
def _(spark, d):
    p = FQ._momentum_panel(spark, d).filter("reversal_1w is not null and gap_1d is not null")
    p = p.withColumn("has_news", F.expr("cast(substring(ticker, 2, 20) as bigint) % 3 = 0"))
    return models.blend_scores(p, price="reversal_1w", news="gap_1d").select("ticker", "decision_session", "prediction")


@query("r3_ticks_to_bars", """
SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS session, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, value)) AS "close", count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2""")
def _(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "value")
    return ingest.ticks_to_bars(ev)
