"""Feature, cross-section, panel, label and weight queries."""

from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import cross_section as xs
from tidemark.operators import features, labels, universe
from tidemark.operators.features import market, smoothing
from tidemark.operators.features.registry import REGISTRY
from tidemark.plans import panel as P
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import feature_sql as FS
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise
from tidemark.sources import fixtures as fx

MIN_NAMES = 5


def setup(spark, d):
    """Bars, sessions and weekly grid of the fixture; the bars, read many times below, become a table first."""
    bars = materialise(fx.bars(spark, d), "bars")
    sessions = cal.sessions(bars)
    return bars, sessions, cal.weekly_grid(sessions)


def _block_query(ids: str, block: str):
    outputs = REGISTRY[block].outputs

    @query(f"{ids}_{block}_features",
           B.with_(B.BARS, *FS.window_features()) + f" SELECT ticker, session, {', '.join(outputs)} FROM feats",
           " ".join(outputs), 7, stoch_k_14=5, money_flow_14=5)
    def _(spark, d):
        return features.price_features(fx.bars(spark, d), blocks=(block,))


for _ids, _block in (("f1_f17", "price"), ("f18_f22", "moments"), ("f23_f39", "technical"), ("f40_f55", "patterns")):
    _block_query(_ids, _block)


@query("f27_f37_smoothed_features", B.with_(B.BARS, *FS.smoothed_features()) + " SELECT * FROM smooth",
       " ".join(smoothing.OUTPUTS), 6)
def _(spark, d):
    return features.price_features(fx.bars(spark, d), blocks=("smoothing",))


@query("f56_f63_market_features", B.with_(B.BARS, *FS.market_features()) + " SELECT * FROM market",
       " ".join(market.OUTPUTS), 7)
def _(spark, d):
    return market.market_features(fx.bars(spark, d))


RANKED = """
sized AS (SELECT *, count(*) OVER (PARTITION BY decision_session) AS names FROM {source})"""


def rank_sql(c: str, date: str = "decision_session", least: int = MIN_NAMES) -> str:
    part = f"PARTITION BY {date}"
    return f"""CASE WHEN {c} IS NOT NULL AND names >= {least} THEN
      (rank() OVER ({part} ORDER BY {c} ASC NULLS LAST) + (count({c}) OVER ({part}, {c}) - 1) / 2.0)
      / count({c}) OVER ({part}) - 0.5 END AS {c}"""


MOMENTUM = [f"""
mom AS (SELECT ticker, session AS decision_session, {FS.COLUMNS['mom_4w']} AS mom_4w,
        {FS.COLUMNS['reversal_1w']} AS reversal_1w, {FS.COLUMNS['gap_1d']} AS gap_1d FROM f0)""", """
raw AS (SELECT mom.* FROM mom JOIN grid USING (decision_session))""",
            RANKED.format(source="raw")]


@query("top_momentum_names", B.with_(B.BARS, B.SESSIONS, B.decisions(), B.grid(), FS.LEVEL_0, *MOMENTUM, f"""
kept AS (SELECT * FROM sized WHERE names >= {MIN_NAMES}),
ranked AS (SELECT ticker, decision_session, {rank_sql('mom_4w')} FROM kept),
ordered AS (SELECT *, row_number() OVER (PARTITION BY decision_session ORDER BY mom_4w DESC, ticker) AS place FROM ranked
            WHERE mom_4w IS NOT NULL)""") + """
SELECT decision_session, ticker, mom_4w AS score, place::INTEGER AS place FROM ordered WHERE place <= 8""", "score")
def top_momentum(spark, d):
    """At each weekly decision, the eight names that rank highest on four-week momentum."""
    from tidemark.operators.book import top_names

    bars, _, grid = setup(spark, d)
    p = P.build_panel(bars, grid, min_names=MIN_NAMES, blocks=("price",), wanted=("mom_4w",))
    return top_names(p, "mom_4w", 8).select(
        "decision_session", "ticker", F.col("mom_4w").alias("score"), F.col("place"))


def _momentum_panel(spark, d):
    bars, _, grid = setup(spark, d)
    marks = grid.select(F.col("decision_session").alias("session"))
    raw = features.price_features(bars, marks, blocks=("price",)).withColumnRenamed("session", "decision_session")
    return raw.select("ticker", "decision_session", "mom_4w", "reversal_1w", "gap_1d")


MOM_BASE = (B.BARS, B.SESSIONS, B.decisions(), B.grid(), FS.LEVEL_0, *MOMENTUM)


def _rank_query(name: str, method: str):
    @query(name, B.with_(*MOM_BASE) + f"""
SELECT ticker, decision_session, {rank_sql('mom_4w')}, {rank_sql('reversal_1w')}, {rank_sql('gap_1d')} FROM sized""",
           "mom_4w reversal_1w gap_1d")
    def _(spark, d):
        return xs.cross_sectional_rank(_momentum_panel(spark, d), ["mom_4w", "reversal_1w", "gap_1d"],
                                       min_names=MIN_NAMES, method=method)


_rank_query("x1_cross_sectional_rank", "window")
_rank_query("x1_cross_sectional_rank_bucketed", "buckets")


def _zscore_query(name: str, method: str):
    @query(name, B.with_(*MOM_BASE, """
q AS (SELECT decision_session, quantile_cont(mom_4w, 0.02) AS lo, quantile_cont(mom_4w, 0.98) AS hi FROM raw GROUP BY 1),
c AS (SELECT raw.ticker, decision_session, CASE WHEN mom_4w IS NOT NULL THEN greatest(least(mom_4w, hi), lo) END AS v
      FROM raw JOIN q USING (decision_session))""") + """
SELECT ticker, decision_session, CASE WHEN count(v) OVER p >= 5 THEN (v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0)
       END AS mom_4w FROM c WINDOW p AS (PARTITION BY decision_session)""", "mom_4w")
    def _(spark, d):
        base = _momentum_panel(spark, d).select("ticker", "decision_session", "mom_4w")
        return xs.cross_sectional_zscore(base, ["mom_4w"], min_names=5, method=method)


_zscore_query("x2_cross_sectional_zscore", "window")
_zscore_query("x2_cross_sectional_zscore_bucketed", "buckets")


@query("x3_sector_neutralize", B.with_(*MOM_BASE, B.MEMBERSHIP, """
s AS (SELECT raw.*, sector FROM raw JOIN universe USING (ticker))""") + """
SELECT ticker, decision_session, sector, CASE WHEN count(mom_4w) OVER p >= 3 THEN mom_4w - avg(mom_4w) OVER p ELSE mom_4w END
       AS mom_4w FROM s WINDOW p AS (PARTITION BY decision_session, sector)""", "mom_4w")
def _(spark, d):
    base = _momentum_panel(spark, d).select("ticker", "decision_session", "mom_4w")
    return xs.sector_neutralize(base.join(universe.sectors(fx.membership(spark, d)), "ticker"), ["mom_4w"])


@query("x4_cross_sectional_demean", B.with_(*MOM_BASE) + """
SELECT ticker, decision_session, mom_4w - avg(mom_4w) OVER (PARTITION BY decision_session) AS mom_4w FROM raw""", "mom_4w")
def _(spark, d):
    return xs.cross_sectional_demean(
        _momentum_panel(spark, d).select("ticker", "decision_session", "mom_4w"), "mom_4w")


@query("x5_drop_thin_dates", B.with_(B.BARS) + """
SELECT ticker, session FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM bars) WHERE n >= 80""")
def _(spark, d):
    return xs.drop_thin_dates(fx.bars(spark, d), date="session", min_names=80).select("ticker", "session")


LABELS = """
pairs AS (SELECT g.decision_session, a.ticker, g.entry_session, g.exit_session, a.open AS open_in, b.open AS open_out
          FROM grid g JOIN bars a ON a.session = g.entry_session JOIN bars b ON b.session = g.exit_session AND b.ticker = a.ticker),
labels AS (SELECT decision_session, ticker, entry_session, exit_session, ln(open_out / open_in) AS raw_return,
             ln(open_out / open_in) - avg(ln(open_out / open_in)) OVER (PARTITION BY decision_session) AS label,
             entry_session AS label_t0, exit_session AS label_t1, 1.0::DOUBLE AS sample_weight
           FROM pairs WHERE open_in > 0 AND open_out > 0)"""
LABEL_BASE = (B.BARS, B.SESSIONS, B.decisions(), B.grid(), LABELS)


@query("x9_labels", B.with_(*LABEL_BASE) + " SELECT * FROM labels", "raw_return label")
def _(spark, d):
    bars, _, grid = setup(spark, d)
    return labels.build_labels(bars, grid)


@query("x10_vol_scaled_labels", B.with_(*LABEL_BASE, f"""
rets AS (SELECT ticker, session, ln("close") - {FS.lag('ln("close")')} AS ret FROM bars),
vols AS (SELECT ticker, session AS decision_session, {FS.r('stddev_samp', 'ret', 65, 32, 1)} * sqrt(252.0) AS vol FROM rets)""")
       + """
SELECT decision_session, ticker, label / nullif(vol, 0) AS label FROM labels JOIN vols USING (decision_session, ticker)
WHERE vol IS NOT NULL AND vol <> 0""", "label")
def _(spark, d):
    bars, _, grid = setup(spark, d)
    return labels.build_labels(bars, grid, vol_scale=True).select("decision_session", "ticker", "label")


@query("x11_forward_returns", B.with_(*LABEL_BASE) + """
SELECT decision_session, ticker, open_out / open_in - 1 AS forward_return FROM pairs WHERE open_in > 0""", "forward_return")
def _(spark, d):
    bars, _, grid = setup(spark, d)
    return labels.forward_returns(bars, grid)


def _long_grid(sessions):
    return cal.weekly_grid(sessions, hold=12)


UNIQUE_SQL = (B.BARS, B.SESSIONS, B.decisions(), B.grid(12), LABELS, """
points AS (SELECT DISTINCT label_t0 AS d FROM labels UNION SELECT DISTINCT label_t1 FROM labels),
spans AS (SELECT label_t0, label_t1, count(*) AS n FROM labels GROUP BY ALL),
active AS (SELECT d, sum(n) AS c FROM points JOIN spans ON d BETWEEN label_t0 AND label_t1 GROUP BY d),
per_span AS (SELECT label_t0, label_t1, avg(1.0::DOUBLE / c) AS w FROM spans JOIN active ON d BETWEEN label_t0 AND label_t1
             GROUP BY ALL),
weighted AS (SELECT labels.*, w FROM labels JOIN per_span USING (label_t0, label_t1))""")


@query("x12_uniqueness_weights", B.with_(*UNIQUE_SQL) + """
SELECT decision_session, ticker, w / avg(w) OVER () AS uniqueness FROM weighted""", "uniqueness")
def _(spark, d):
    bars = fx.bars(spark, d)
    out = labels.uniqueness_weights(labels.build_labels(bars, _long_grid(cal.sessions(bars))))
    return out.select("decision_session", "ticker", "uniqueness")


RECENCY = "pow(0.5, datediff('day', decision_session, max(decision_session) OVER ()) / 7.0::DOUBLE / 26.0::DOUBLE)"


@query("x13_recency_weights", B.with_(*LABEL_BASE, f"aged AS (SELECT decision_session, ticker, {RECENCY} AS a FROM labels)") + """
SELECT decision_session, ticker, a / avg(a) OVER () AS recency FROM aged""", "recency")
def _(spark, d):
    bars, _, grid = setup(spark, d)
    out = labels.recency_weights(labels.build_labels(bars, grid), half_life_weeks=26.0)
    return out.select("decision_session", "ticker", "recency")


@query("x14_combined_weights", B.with_(*UNIQUE_SQL, f"""
prod AS (SELECT decision_session, ticker, w * {RECENCY} AS p FROM weighted)""") + """
SELECT decision_session, ticker, p / avg(p) OVER () AS sample_weight FROM prod""", "sample_weight")
def _(spark, d):
    bars = fx.bars(spark, d)
    made = labels.build_labels(bars, _long_grid(cal.sessions(bars)))
    return labels.training_weights(made, half_life_weeks=26.0).select("decision_session", "ticker", "sample_weight")


@query("x14_product_of_weights", B.with_(B.BARS) + """
SELECT ticker, session, "close" * volume / avg("close" * volume) OVER () AS sample_weight FROM bars""", "sample_weight")
def _(spark, d):
    bars = fx.bars(spark, d)
    return labels.combine_weights(bars, ["close", "volume"]).select("ticker", "session", "sample_weight")


PANEL_COLS = tuple(features.FEATURES)


PANEL_CTES = (
    B.BARS, B.SESSIONS, B.decisions(), B.grid(), B.MEMBERSHIP, LABELS, *FS.window_features(for_ranks=True), *FS.smoothed_features(),
    *FS.market_features(), """
joined AS (SELECT f.session AS decision_session, f.* EXCLUDE (session), smooth.* EXCLUDE (ticker, session),
                  market.* EXCLUDE (session)
           FROM feats f JOIN grid ON grid.decision_session = f.session
           LEFT JOIN smooth ON smooth.ticker = f.ticker AND smooth.session = f.session
           LEFT JOIN market ON market.session = f.session),
members AS (SELECT joined.*, sector FROM joined JOIN universe ON universe.ticker = joined.ticker
            AND decision_session BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31')),
attached AS (SELECT members.*, label FROM members LEFT JOIN (SELECT decision_session, ticker, label FROM labels)
             USING (decision_session, ticker)),
sized AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY decision_session) AS names FROM attached) WHERE names >= 5)""")


@query("x6_feature_panel", B.with_(*PANEL_CTES)
       + f" SELECT decision_session, ticker, sector, label, {', '.join(rank_sql(c) for c in PANEL_COLS)} FROM sized",
       "label " + " ".join(PANEL_COLS))
def feature_panel(spark, d):
    """The ranked 63-feature panel with sector and label."""
    return full_panel(spark, d).select("decision_session", "ticker", "sector", "label", *PANEL_COLS)


def full_panel(spark, d, **kw):
    bars, sessions, grid = setup(spark, d)
    return P.build_panel(
        bars, grid, membership=universe.membership_panel(fx.membership(spark, d), sessions),
        labels=labels.build_labels(bars, grid), min_names=MIN_NAMES, **kw)


@query("x7_panel_asof", B.with_(
    B.BARS.replace("bars AS", "every_bar AS"), "bars AS (SELECT * FROM every_bar WHERE session <= DATE '2000-12-29')",
    *FS.window_features()) + """
SELECT ticker, session, mom_12w, vol_13w, bb_position_20, breakout_60d FROM feats""",
    "mom_12w vol_13w bb_position_20 breakout_60d")
def _(spark, d):
    out = P.raw_features(fx.bars(spark, d), asof="2000-12-29", blocks=features.WINDOW_BLOCKS)
    return out.select("ticker", "session", "mom_12w", "vol_13w", "bb_position_20", "breakout_60d")


@query("x8_feature_columns", B.with_(*PANEL_CTES) + " UNION ALL ".join(
    f" SELECT '{c}' AS feature, 'price' AS side, count({c}) AS n_values FROM sized" for c in PANEL_COLS))
def _(spark, d):
    """Each model feature, the side of the blend its name puts it on, and how many panel rows carry a value."""
    p = full_panel(spark, d, normalize=False)
    news = P.news_feature_columns(p)
    counts = p.agg(*[F.count(c).alias(c) for c in P.feature_columns(p)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit("news" if c in news else "price").alias("side"),
                              F.col(c).alias("n_values")) for c in P.feature_columns(p)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


CHECKED = ["mom_12w", "vol_13w", "breakout_60d", "rsi_14", "mkt_vol_13w"]


@query("v24_lookahead_check", B.with_(B.BARS) + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) AS n_compared, 0::BIGINT AS n_different FROM bars
WHERE session = DATE '2000-10-06' """ for c in CHECKED))
def _(spark, d):
    """Features at a cut-off from the full and from the truncated history: no value may differ."""
    from tidemark.operators.splits import lookahead_differences

    return lookahead_differences(fx.bars(spark, d), "2000-10-06", CHECKED)
