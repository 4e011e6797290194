"""Predictions, books, costs, orders, fills, ledger and validation queries."""

from pyspark.sql import functions as F

from tidemark.operators import book, costs, fills, labels, orders, performance, skill, splits, universe
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import feature_queries as FQ
from tidemark.plans.catalog import feature_sql as FS
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise
from tidemark.sources import fixtures as fx

PRED = """
preds AS (SELECT r.ticker, decision_session, reversal_1w AS prediction, label, label_t0, label_t1,
            (dense_rank() OVER (ORDER BY decision_session) - 1) // 8 AS fold
          FROM raw r LEFT JOIN labels USING (decision_session, ticker) WHERE reversal_1w IS NOT NULL),
complete AS (SELECT *, rank() OVER (PARTITION BY decision_session ORDER BY prediction) + (count(*) OVER (PARTITION BY decision_session, prediction) - 1) / 2.0 AS rp,
               rank() OVER (PARTITION BY decision_session ORDER BY label) + (count(*) OVER (PARTITION BY decision_session, label) - 1) / 2.0 AS rl
             FROM preds WHERE label IS NOT NULL),
ic AS (SELECT decision_session, corr(rp, rl) AS ic, count(*) AS n FROM complete GROUP BY 1 HAVING count(*) >= 10)"""
BASE = (*FQ.MOM_BASE, FQ.LABELS, PRED)


def predictions(spark, d):
    """One-week reversal as the prediction, with labels; folds are runs of eight weeks."""
    from pyspark.sql import Window

    bars, _, grid = FQ.setup(spark, d)
    from tidemark.operators import features

    raw = features.price_features(bars, grid.select(F.col("decision_session").alias("session")), blocks=("price",))
    raw = raw.select("ticker", F.col("session").alias("decision_session"), F.col("reversal_1w").alias("prediction"))
    weeks = grid.select("decision_session")
    p = raw.filter("prediction is not null").join(labels.build_labels(bars, grid), ["decision_session", "ticker"], "left")
    index = raw.filter("prediction is not null").select("decision_session").distinct().join(weeks, "decision_session").select(
        "decision_session", ((F.row_number().over(Window.orderBy("decision_session")) - 1) / 8).cast("int").alias("fold"))
    return p.join(index, "decision_session"), bars, grid


@query("v1_periodic_ic", B.with_(*BASE) + " SELECT * FROM ic", "ic")
def _(spark, d):
    return skill.periodic_ic(predictions(spark, d)[0])


IC_STATS = """count(*) AS n_periods, avg(ic) AS mean_ic, median(ic) AS median_ic, coalesce(stddev_samp(ic), 0) AS ic_std,
  avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate, avg(ic) / stddev_samp(ic) AS ic_ir,
  avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat"""
IC_DOUBLES = "mean_ic median_ic ic_std hit_rate ic_ir t_stat"


@query("v2_ic_summary", B.with_(*BASE) + f" SELECT {IC_STATS} FROM ic", IC_DOUBLES)
def _(spark, d):
    return skill.ic_statistics(skill.periodic_ic(predictions(spark, d)[0]))


def ic_verdict(spark, d):
    return skill.ic_verdict(skill.with_p_value(skill.ic_statistics(skill.periodic_ic(predictions(spark, d)[0]))))


EDGES = """
edges AS (SELECT decision_session, list_sort(list_distinct(quantile_cont(prediction, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q
          FROM complete GROUP BY 1 HAVING count(*) >= 10),
slot AS (SELECT decision_session, label, greatest(len(list_filter(q, lambda e: e < prediction)) - 1, 0) AS bucket
           FROM complete JOIN edges USING (decision_session)),
buckets AS (SELECT bucket::INTEGER AS bucket, avg(m) AS mean_label FROM (SELECT decision_session, bucket, avg(label) AS m FROM slot GROUP BY ALL) GROUP BY 1)"""


@query("v3_quantile_returns", B.with_(*BASE, EDGES) + " SELECT * FROM buckets", "mean_label")
def _(spark, d):
    return skill.quantile_returns(predictions(spark, d)[0])


@query("v4_monotonicity", B.with_(*BASE, EDGES, "r AS (SELECT *, rank() OVER (ORDER BY mean_label) AS k FROM buckets)") + """
SELECT arg_max(mean_label, bucket) - arg_min(mean_label, bucket) AS spread, corr(bucket, k) AS monotonicity FROM r""", "spread monotonicity")
def _(spark, d):
    return skill.monotonicity(skill.quantile_returns(predictions(spark, d)[0]))


@query("v5_fold_clustered_ic", B.with_(*BASE, """
f AS (SELECT fold, avg(ic) AS ic FROM ic JOIN (SELECT DISTINCT decision_session, fold FROM preds) USING (decision_session) GROUP BY fold)""")
       + f" SELECT {IC_STATS} FROM f", IC_DOUBLES)
def _(spark, d):
    return skill.fold_clustered_ic(predictions(spark, d)[0])


WF = {"train_weeks": 26, "test_weeks": 8, "min_train_weeks": 20}
FOLDS = """
wk AS (SELECT decision_session, row_number() OVER (ORDER BY decision_session) - 1 AS week, count(*) OVER () AS n
       FROM (SELECT DISTINCT decision_session FROM labels)),
fw AS (SELECT f AS fold, 26 + f * 8 AS a, least(34 + f * 8, (SELECT max(n) FROM wk)) AS b FROM range(0, 40) t(f)
       WHERE least(34 + f * 8, (SELECT max(n) FROM wk)) - (26 + f * 8) >= 2),
asg AS (SELECT fold, CASE WHEN week < a THEN 'train' ELSE 'test' END AS role0, labels.* FROM fw JOIN wk ON week < b JOIN labels USING (decision_session)),
span AS (SELECT fold, min(label_t0) AS lo, max(label_t1) AS hi FROM asg WHERE role0 = 'test' GROUP BY 1),
folds AS (SELECT fold, CASE WHEN role0 = 'test' THEN 'test' WHEN label_t0 <= hi AND label_t1 >= lo THEN 'purged'
            WHEN label_t1 >= lo - 7 AND label_t1 < lo THEN 'embargoed' ELSE 'train' END AS role, decision_session, ticker
          FROM asg JOIN span USING (fold))"""


def _labels(spark, d):
    bars, _, grid = FQ.setup(spark, d)
    return labels.build_labels(bars, grid)


@query("v16_walk_forward_folds", B.with_(*FQ.LABEL_BASE, FOLDS) + " SELECT fold::INTEGER AS fold, role, decision_session, ticker FROM folds")
def _(spark, d):
    return splits.walk_forward_folds(_labels(spark, d), embargo_weeks=1, **WF).select("fold", "role", "decision_session", "ticker")


@query("v17_overlap_report", B.with_(*FQ.LABEL_BASE, FOLDS) + """
SELECT fold::INTEGER AS fold, 0::BIGINT AS n_overlapping, 0::BIGINT AS n_in_embargo FROM folds WHERE role = 'train' GROUP BY fold""")
def _(spark, d):
    return splits.overlap_report(splits.walk_forward_folds(_labels(spark, d), embargo_weeks=1, **WF), embargo_weeks=1)


@query("v18_combinatorial_folds", B.with_(*FQ.LABEL_BASE, """
wk AS (SELECT decision_session, row_number() OVER (ORDER BY decision_session) - 1 AS week, count(*) OVER () AS n FROM (SELECT DISTINCT decision_session FROM labels)),
gr AS (SELECT decision_session, CASE WHEN week < (n % 6) * (n // 6 + 1) THEN week // (n // 6 + 1) ELSE n % 6 + (week - (n % 6) * (n // 6 + 1)) // (n // 6) END AS g FROM wk),
pick AS (SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS fold, a.range AS a, b.range AS b FROM range(6) a JOIN range(6) b ON a.range < b.range),
rw AS (SELECT fold, g = a OR g = b AS tested, l.* FROM gr JOIN labels l USING (decision_session) JOIN pick ON TRUE),
sp AS (SELECT fold, min(label_t0) AS lo, max(label_t1) AS hi FROM rw WHERE tested GROUP BY 1),
ro AS (SELECT rw.*, CASE WHEN tested THEN 'test' WHEN label_t0 <= hi AND label_t1 >= lo THEN 'purged'
         WHEN (label_t1 >= lo - 7 AND label_t1 < lo) OR (label_t0 > hi AND label_t0 <= hi + 7) THEN 'embargoed' ELSE 'train' END AS role FROM rw JOIN sp USING (fold))""") + """
SELECT fold::INTEGER AS fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'purged') AS purged,
       count(*) FILTER (role = 'embargoed') AS embargoed, min(decision_session) FILTER (role <> 'test') AS train_start, max(decision_session) FILTER (role <> 'test') AS train_end,
       min(decision_session) FILTER (role = 'test') AS test_start, max(decision_session) FILTER (role = 'test') AS test_end
FROM ro GROUP BY 1 HAVING count(*) FILTER (role = 'train') > 0 AND count(*) FILTER (role = 'test') > 0""")
def _(spark, d):
    return splits.fold_summary(splits.combinatorial_folds(_labels(spark, d), n_groups=6, n_test_groups=2, embargo_weeks=1))


PICK = """
sc AS (SELECT p.ticker, decision_session, prediction - avg(prediction) OVER (PARTITION BY decision_session) AS score FROM preds p),
num AS (SELECT *, count(*) OVER (PARTITION BY decision_session) AS n, row_number() OVER (PARTITION BY decision_session ORDER BY score DESC, ticker) AS rt,
          row_number() OVER (PARTITION BY decision_session ORDER BY score, ticker DESC) AS rb FROM sc),
picked AS (SELECT ticker, decision_session, score FROM num WHERE (score > 0 AND rt <= CASE WHEN n < 30 THEN least(8, greatest(1, n // 4)) ELSE 8 END)
             OR (score < 0 AND rb <= CASE WHEN n < 30 THEN least(7, greatest(1, n // 4)) ELSE 7 END))"""


def scores(spark, d):
    from tidemark.operators.cross_section import cross_sectional_demean

    p, bars, grid = predictions(spark, d)
    return cross_sectional_demean(p.select("ticker", "decision_session", F.col("prediction").alias("score")), "score"), bars, grid


@query("p1_p2_equal_weight_book", B.with_(*BASE, PICK) + """
SELECT decision_session, ticker, sign(score) / sum(abs(sign(score))) OVER (PARTITION BY decision_session) AS weight FROM picked""", "weight", 9)
def _(spark, d):
    return book.equal_weights(book.select_names(scores(spark, d)[0])).select("decision_session", "ticker", "weight")


STATS = f"""
st0 AS (SELECT *, CASE WHEN "close" > 0 THEN ln("close") END - {FS.lag('CASE WHEN "close" > 0 THEN ln("close") END')} AS ret, (high - low) / nullif("close", 0) AS hl,
          "close" * volume AS nv FROM bars),
stats AS (SELECT ticker, session AS decision_session, {FS.r('stddev_samp', 'ret', 65, 30, 1)} * sqrt(252.0) AS volatility,
            {FS.r('avg', 'nv', 20, 10, 1)} AS adv_notional, {FS.r('avg', 'hl', 20, 10, 1)} AS hl_range FROM st0)"""


@query("b1_trailing_stats", B.with_(B.BARS, STATS) + """
SELECT ticker, decision_session AS session, volatility, adv_notional, hl_range FROM stats""", "volatility adv_notional hl_range", 6, adv_notional=1)
def _(spark, d):
    return performance.trailing_stats(fx.bars(spark, d))


INVVOL = """
pv AS (SELECT picked.*, volatility FROM picked LEFT JOIN stats USING (ticker, decision_session)),
fl AS (SELECT decision_session, quantile_cont(CASE WHEN volatility > 0 THEN volatility END, 0.1) AS f,
         median(CASE WHEN volatility > 0 THEN volatility END) AS m FROM pv GROUP BY 1),
iw AS (SELECT pv.*, CASE WHEN m IS NULL THEN sign(score) ELSE sign(score) / greatest(coalesce(volatility, m), greatest(f, 0.0001)) END AS x FROM pv JOIN fl USING (decision_session)),
weighted AS (SELECT *, x / sum(abs(x)) OVER (PARTITION BY decision_session) AS weight FROM iw)"""


def sized(spark, d):
    s, bars, grid = scores(spark, d)
    stats = performance.trailing_stats(bars).withColumnRenamed("session", "decision_session")
    picked = book.select_names(s).join(stats, ["decision_session", "ticker"], "left")
    # A book is small and is read several times by what follows.
    return materialise(book.normalize_gross(book.inverse_vol_weights(picked)), "book"), bars, grid, stats


@query("p3_p4_inverse_vol_book", B.with_(*BASE, PICK, STATS, INVVOL) + " SELECT decision_session, ticker, weight FROM weighted", "weight", 9)
def _(spark, d):
    return sized(spark, d)[0].select("decision_session", "ticker", "weight")


def _limit_sql() -> list[str]:
    out = ["""
l0 AS (SELECT decision_session, ticker, sector, weight / greatest(1, sum(abs(weight)) OVER p) AS w, FALSE AS done
       FROM weighted JOIN universe USING (ticker) WINDOW p AS (PARTITION BY decision_session))"""]
    for i in range(8):
        out.append(f"""
r{i} AS (SELECT *, w * CASE WHEN sum(abs(w)) OVER p > 1 + 1e-12 THEN 1 / sum(abs(w)) OVER p ELSE 1 END AS w3 FROM (
  SELECT *, w1 * CASE WHEN sum(abs(w1)) OVER s > 0.35 + 1e-12 THEN 0.35::DOUBLE / sum(abs(w1)) OVER s ELSE 1 END AS w2 FROM (
    SELECT *, sign(w) * least(abs(w), 0.12::DOUBLE) AS w1 FROM l{i}) WINDOW s AS (PARTITION BY decision_session, sector))
  WINDOW p AS (PARTITION BY decision_session)),
l{i + 1} AS (SELECT decision_session, ticker, sector, CASE WHEN done THEN w ELSE nw END AS w,
  done OR bool_and(abs(nw - w) <= 1e-12 + 1e-5 * abs(w)) OVER (PARTITION BY decision_session) AS done
  FROM (SELECT *, w2 * CASE WHEN sum(abs(w2)) OVER p > 1 + 1e-12 THEN 1 / sum(abs(w2)) OVER p ELSE 1 END AS nw FROM r{i}
        WINDOW p AS (PARTITION BY decision_session)))""")
    out.append("""
dust AS (SELECT decision_session, ticker, CASE WHEN abs(w) < 0.001 THEN 0 ELSE w END AS w FROM l8),
net AS (SELECT *, sum(w) OVER p AS net, sum(CASE WHEN sign(w) = sign(nt) THEN abs(w) ELSE 0 END) OVER p AS sg
        FROM (SELECT *, sum(w) OVER (PARTITION BY decision_session) AS nt FROM dust) WINDOW p AS (PARTITION BY decision_session)),
limited AS (SELECT decision_session, ticker, CASE WHEN abs(net) > 0.3 + 1e-12 AND sg > 1e-9 AND sign(w) = sign(net)
              THEN w * greatest(0, 1 - (abs(net) - 0.3) / sg) ELSE w END AS weight FROM net)""")
    return out


@query("p9_limits", B.with_(*BASE, PICK, STATS, INVVOL, B.MEMBERSHIP, *_limit_sql()) + " SELECT * FROM limited", "weight", 7)
def limited(spark, d):
    b = sized(spark, d)[0].join(universe.sectors(fx.membership(spark, d)), "ticker")
    return book.apply_limits(b.select("decision_session", "ticker", "sector", "weight")).select("decision_session", "ticker", "weight")


def target_vol_book(spark, d):
    """Volatility-targeted books from the shrunk covariance of the names' weekly returns."""
    from tidemark.operators.calendar import simple_weekly_returns

    b, bars, _, _ = sized(spark, d)
    vol = book.portfolio_volatility(materialise(book.return_history(b, simple_weekly_returns(bars)), "history"))
    return book.scale_to_target_vol(b, vol).select("decision_session", "ticker", "weight", "vol_scale")


@query("p10_limit_violations", B.with_(*BASE, PICK, STATS, INVVOL, B.MEMBERSHIP, """
w AS (SELECT decision_session, sector, weight * CASE WHEN weight > 0 THEN 3.0 ELSE 1.0 END AS weight FROM weighted JOIN universe USING (ticker)),
v AS (SELECT decision_session, 'weight' AS rule, '' AS detail, max(abs(weight)) AS value, 0.12 AS bound FROM w GROUP BY 1
      UNION ALL SELECT decision_session, 'gross', '', sum(abs(weight)), 1.0 FROM w GROUP BY 1
      UNION ALL SELECT decision_session, 'net', '', abs(sum(weight)), 0.3 FROM w GROUP BY 1
      UNION ALL SELECT decision_session, 'sector', sector, sum(abs(weight)), 0.35 FROM w GROUP BY 1, 3)""") + """
SELECT decision_session, rule, detail, value FROM v WHERE value > bound + 1e-6""", "value")
def _(spark, d):
    """Books with tripled longs break every rule somewhere."""
    b = sized(spark, d)[0].join(universe.sectors(fx.membership(spark, d)), "ticker")
    b = b.withColumn("weight", F.col("weight") * F.when(F.col("weight") > 0, 3.0).otherwise(1.0))
    return book.check_limits(b.select("decision_session", "ticker", "sector", "weight")).select("decision_session", "rule", "detail", "value")


FEES = costs.INDIA
TRADE = """
tr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS n, l_returnflag = 'A' AS buy, l_linestatus = 'F' AS short,
         l_discount AS vol, l_tax AS rng, l_quantity * 100000 AS adv FROM lineitem),
tc AS (SELECT *, n * CASE WHEN short THEN 2.0 ELSE 3.0 END * 1e-4 AS commission, n * CASE WHEN short THEN 0.2 ELSE 0.3 END * 1e-4 AS exch,
         CASE WHEN short THEN CASE WHEN buy THEN 0.2 ELSE 2.0 END ELSE CASE WHEN buy THEN 11.5 ELSE 10.0 END END AS stat FROM tr)"""


@query("c1_c3_trade_cost", B.with_(TRADE) + """
SELECT l_partkey, ln(1 + sum(commission)) AS commission, ln(1 + sum(n * stat * 1e-4 + exch + (commission + exch) * 0.18)) AS taxes,
       ln(1 + sum(n * CASE WHEN rng > 0 THEN greatest(3.0, least(rng * 10000 * 0.02, 50.0)) ELSE 3.0 END * 1e-4)) AS spread,
       ln(1 + sum(n * 0.6 * vol / sqrt(252.0) * 10000 * sqrt(least(n / adv, 1)) * 1e-4)) AS impact FROM tc GROUP BY 1""",
       "commission taxes spread impact", 7)
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    parts = costs.trade_cost("l_extendedprice", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", FEES, vol="l_discount",
                             adv=F.col("l_quantity") * 100_000, day_range="l_tax")
    return li.select("l_partkey", *[c.alias(k) for k, c in parts.items()]).groupBy("l_partkey").agg(
        *[F.log1p(F.sum(k)).alias(k) for k in parts])  # logarithms: sums of short decimals would tie when rounded


FILLS = """
fo AS (SELECT strftime(l_shipdate, '%Y-%m') AS run, l_extendedprice / l_quantity AS price, l_quantity AS quantity, p_retailprice AS ref,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_tax * 100 AS expected FROM lineitem JOIN part ON p_partkey = l_partkey),
jd AS (SELECT *, price * quantity AS notional, CASE side WHEN 'buy' THEN 1 ELSE -1 END * (price - ref) / ref * 10000 AS bps FROM fo),
us AS (SELECT *, abs(bps) <= 2000 AS used FROM jd),
rep AS (SELECT run, count(*) AS n_orders, count(*) FILTER (used) AS n_filled, coalesce(sum(notional) FILTER (used), 0) AS total_notional,
          sum(bps * notional) FILTER (used) / sum(notional) FILTER (used) AS weighted_slippage_bps, median(bps) FILTER (used) AS median_slippage_bps,
          sum(expected * notional) FILTER (used) / sum(notional) FILTER (used) AS weighted_expected_bps,
          coalesce(sum(bps / 10000 * notional) FILTER (used), 0) AS slippage_cost FROM us GROUP BY run)"""


def fill_report(spark, d):
    li, part = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("run"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey").alias("client_order_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("est_price"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_tax") * 100).alias("expected_slip_bps"))
    key = ("run", "client_order_id")
    return fills.analyse_fills(rows.select(*key, "price", "quantity"), rows.drop("price"), key=key)


@query("t1_t2_fill_analysis", B.with_(FILLS) + """
SELECT run, n_orders, n_filled, total_notional, weighted_slippage_bps, median_slippage_bps, weighted_expected_bps, slippage_cost FROM rep""",
       "total_notional weighted_slippage_bps median_slippage_bps weighted_expected_bps slippage_cost", 5)
def _(spark, d):
    return fill_report(spark, d).select("run", "n_orders", "n_filled", "total_notional", "weighted_slippage_bps", "median_slippage_bps",
                                        "weighted_expected_bps", "slippage_cost")


@query("t3_pooled_slippage", B.with_(FILLS) + """
SELECT count(*) AS n_weeks, sum(slippage_cost) / sum(total_notional) * 10000 AS realised_bps,
       sum(weighted_expected_bps * total_notional) / sum(total_notional) AS expected_bps FROM rep WHERE n_filled > 0""", "realised_bps expected_bps", 4)
def _(spark, d):
    return fills.pool_weeks(fill_report(spark, d)).select("n_weeks", "realised_bps", "expected_bps")


def performance_report(spark, d):
    """Metrics of the inverse-volatility book after costs, and of holding everything."""
    b, bars, grid, stats = sized(spark, d)
    forward = labels.forward_returns(bars, grid)
    c = costs.rebalance_cost(b.select("decision_session", "ticker", "weight"), grid, stats, FEES)
    ledger = performance.weekly_ledger(b, forward, c, weeks=b.select("decision_session").union(c.select("decision_session"))).withColumn("scenario", F.lit("book"))
    hold = performance.benchmark(b, forward).withColumn("scenario", F.lit("hold"))
    return performance.metrics(ledger.unionByName(hold, allowMissingColumns=True))


@query("b6_v7_benchmark_metrics", B.with_(*FQ.LABEL_BASE, """
b AS (SELECT decision_session, avg(open_out / open_in - 1) AS r FROM pairs WHERE open_in > 0 GROUP BY 1),
e AS (SELECT *, product(1 + r) OVER (ORDER BY decision_session) AS eq FROM b),
dd AS (SELECT *, eq / max(eq) OVER (ORDER BY decision_session) - 1 AS dd FROM e)""") + """
SELECT 'hold' AS scenario, count(*) AS n_periods, sum(ln(1 + r)) AS total_return, avg(r) * 52 AS ann_return, stddev_samp(r) * sqrt(52.0) AS ann_vol,
       avg(r) * 52 / (stddev_samp(r) * sqrt(52.0)) AS sharpe, min(dd) AS max_drawdown, skewness(r) AS skew FROM dd""",
       "total_return ann_return ann_vol sharpe max_drawdown skew")
def _(spark, d):
    bars, _, grid = FQ.setup(spark, d)
    f = labels.forward_returns(bars, grid)
    return performance.metrics(performance.benchmark(f, f).withColumn("scenario", F.lit("hold"))).select(
        "scenario", "n_periods", F.log1p("total_return").alias("total_return"), "ann_return", "ann_vol", "sharpe", "max_drawdown", "skew")


@query("v15_trial_summary", """
SELECT n_name AS market, count(*) AS n_trials, count(DISTINCT p_brand) AS n_configs, max(s) AS best_sharpe, median(s) AS median_sharpe,
       CASE WHEN count(*) >= 3 AND var_samp(s) > 1e-9 THEN var_samp(s) ELSE 1 END AS sharpe_variance FROM (
  SELECT n_name, p_brand, avg(l_discount - l_tax) * 10 AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1""", "best_sharpe median_sharpe sharpe_variance")
def _(spark, d):
    li, s, n, p = (fx.table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    trials = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey).groupBy(
        F.col("n_name").alias("market"), F.sha2("p_brand", 256).alias("config_hash")).agg(
            (F.avg(F.col("l_discount") - F.col("l_tax")) * 10).alias("sharpe"))
    return performance.trial_summary(trials)


def newest_orders(spark, d):
    """Orders of the newest book from a flat start, in working sequence."""
    b, bars, _, _ = sized(spark, d)
    last = b.join(b.agg(F.max("decision_session").alias("decision_session")), "decision_session")
    prices = bars.groupBy("ticker").agg(F.max_by("close", "session").alias("price"))
    made = orders.build_orders(book.book_frame(last), prices, b.select("ticker", F.lit(0.0).alias("shares")).distinct(),
                               universe.lot_sizes(fx.membership(spark, d)), equity=1e6)
    return orders.execution_sequence(made.filter("is_order"))


TWO_BOOKS = """
eqw AS (SELECT decision_session, ticker, sign(score) / sum(abs(sign(score))) OVER (PARTITION BY decision_session) AS weight FROM picked),
bars_next AS (SELECT decision_session AS d, lead(decision_session) OVER (ORDER BY decision_session) AS nxt FROM (SELECT DISTINCT decision_session FROM eqw)),
prev AS (SELECT nxt AS decision_session, ticker, weight AS pw FROM eqw JOIN bars_next ON d = decision_session WHERE nxt IS NOT NULL),
sides AS (SELECT decision_session, ticker, coalesce(weight, 0) AS w, coalesce(pw, 0) AS pw FROM eqw FULL JOIN prev USING (decision_session, ticker))"""


def two_books(spark, d):
    """Equal-weight books and, under the same date, the book of the week before."""
    from pyspark.sql import Window

    b = materialise(book.equal_weights(book.select_names(scores(spark, d)[0])).select("decision_session", "ticker", "weight"), "book")
    order = b.select("decision_session").distinct().withColumn("_next", F.lead("decision_session").over(Window.orderBy("decision_session")))
    prev = b.join(order, "decision_session").filter("_next is not null").select(  # one row per week
        F.col("_next").alias("decision_session"), "ticker", "weight")
    return b, prev


@query("p12_no_trade_band", B.with_(*BASE, PICK, TWO_BOOKS) + """
SELECT * FROM (SELECT decision_session, ticker, CASE WHEN abs(w - pw) < 0.02 AND abs(pw) > 1e-9 THEN pw ELSE w END AS weight FROM sides)
WHERE abs(weight) > 1e-9""", "weight", 9)
def _(spark, d):
    return book.no_trade_band(*two_books(spark, d), band=0.02)


@query("p13_participation_cap", B.with_(*BASE, PICK, STATS, TWO_BOOKS) + """
SELECT decision_session, ticker, weight FROM (
  SELECT decision_session, ticker, CASE WHEN abs(w - pw) * 1e6 > adv_notional * 0.05 THEN pw + sign(w - pw) * adv_notional * 0.05 / 1e6 ELSE w END AS weight
  FROM sides LEFT JOIN stats USING (decision_session, ticker)) WHERE abs(weight) > 1e-9""", "weight", 9)
def _(spark, d):
    target, prev = two_books(spark, d)
    adv = performance.trailing_stats(fx.bars(spark, d)).withColumnRenamed("session", "decision_session")
    return book.participation_cap(target, prev, adv, capital=1e6).select("decision_session", "ticker", "weight")


@query("p14_hard_to_borrow", B.with_(*BASE, PICK, TWO_BOOKS) + """
SELECT decision_session, ticker, weight FROM eqw WHERE weight >= 0 OR substr(ticker, 2)::BIGINT % 4 <> 0""", "weight", 9)
def _(spark, d):
    blocked = fx.membership(spark, d).filter("file_order % 4 = 0").select("ticker")
    return book.hard_to_borrow_filter(two_books(spark, d)[0], blocked).select("decision_session", "ticker", "weight")


@query("v11_turnover", B.with_(*BASE, PICK, TWO_BOOKS) + """
SELECT decision_session, sum(abs(w - pw)) / 2 AS turnover FROM sides GROUP BY 1""", "turnover")
def _(spark, d):
    return performance.turnover(two_books(spark, d)[0])
