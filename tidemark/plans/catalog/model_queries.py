"""Model, calibration, ablation and path queries."""

from pyspark.sql import functions as F

from tidemark.functions.distributions import expected_max_sharpe
from tidemark.operators import ablation, book, calibration, costs, fold_ridge, labels, models, performance, skill, splits
from tidemark.operators.features.registry import REGISTRY
from tidemark.plans import panel as P
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog import evaluation_queries as EQ
from tidemark.plans.catalog import feature_queries as FQ
from tidemark.plans.catalog import feature_sql as FS
from tidemark.plans.catalog import money_queries as MQ
from tidemark.plans.catalog import news_queries as NQ
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise

PRICE = list(REGISTRY["price"].outputs)
WEEKS = {"train_weeks": 40, "test_weeks": 12, "min_train_weeks": 30}


def price_panel(spark, d):
    """The ranked price block on the decision rows, with labels."""
    return panel_of(*FQ.setup(spark, d)[::2])


def panel_of(bars, grid):
    return materialise(P.build_panel(bars, grid, labels=labels.build_labels(bars, grid), min_names=FQ.MIN_NAMES, blocks=("price",)), "panel")


def price_folds(panel):
    return materialise(splits.walk_forward_folds(panel.filter("label is not null"), embargo_weeks=1, **WEEKS), "folds")


def folds_sql(first: int, step: int, source: str = "panel") -> str:
    """Expanding folds whose tests begin at week ``first`` and last ``step`` weeks, over the labelled rows of ``source``."""
    return f"""
known AS (SELECT * FROM {source} WHERE label IS NOT NULL),
wk AS (SELECT decision_session, row_number() OVER (ORDER BY decision_session) - 1 AS week, count(*) OVER () AS n FROM (SELECT DISTINCT decision_session FROM known)),
fw AS (SELECT f AS fold, {first} + f * {step} AS a, least({first + step} + f * {step}, (SELECT max(n) FROM wk)) AS b FROM range(0, 40) t(f)
       WHERE least({first + step} + f * {step}, (SELECT max(n) FROM wk)) - ({first} + f * {step}) >= {max(1, step // 4)}),
asg AS (SELECT fold, CASE WHEN week < a THEN 'train' ELSE 'test' END AS role0, known.* FROM fw JOIN wk ON week < b JOIN known USING (decision_session)),
span AS (SELECT fold, min(label_t0) AS lo, max(label_t1) AS hi FROM asg WHERE role0 = 'test' GROUP BY 1),
rows AS (SELECT CASE WHEN role0 = 'test' THEN 'test' WHEN label_t0 <= hi AND label_t1 >= lo THEN 'purged'
           WHEN label_t1 >= lo - 7 AND label_t1 < lo THEN 'embargoed' ELSE 'train' END AS role, asg.* FROM asg JOIN span USING (fold))"""


PANEL = (B.BARS, B.SESSIONS, B.decisions(), B.grid(), FQ.LABELS, *FS.window_features(for_ranks=True), """
joined AS (SELECT f.session AS decision_session, f.* EXCLUDE (session), label, label_t0, label_t1 FROM feats f JOIN grid ON grid.decision_session = f.session
           LEFT JOIN (SELECT decision_session, ticker, label, label_t0, label_t1 FROM labels) l ON l.decision_session = f.session AND l.ticker = f.ticker),
sized AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY decision_session) AS names FROM joined) WHERE names >= 5)""", f"""
panel AS (SELECT decision_session, ticker, label, label_t0, label_t1, {', '.join(FQ.rank_sql(c) for c in PRICE)} FROM sized)""")

_VALUES = ", ".join(f"{c} AS v{i}" for i, c in enumerate(PRICE))
#: Normal equations of every fold, solved by elimination: one round for each feature.
RIDGE = (*PANEL, folds_sql(40, 12), f"""
long AS (SELECT fold, role, decision_session, ticker, label, i, list_extract([{', '.join(PRICE)}], i + 1) AS v FROM rows, range({len(PRICE)}) t(i)),
fills AS (SELECT fold, i, coalesce(median(v), 0) AS f FROM long WHERE role = 'train' GROUP BY 1, 2),
filled AS (SELECT long.* EXCLUDE (v), coalesce(v, f) AS v FROM long JOIN fills USING (fold, i)),
gram AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS v
         FROM filled a JOIN filled b ON a.fold = b.fold AND a.decision_session = b.decision_session AND a.ticker = b.ticker
         WHERE a.role = 'train' AND b.role = 'train' GROUP BY a.fold, a.i, b.i
         UNION ALL SELECT fold, i, {len(PRICE)}, sum(v * label) FROM filled WHERE role = 'train' GROUP BY 1, 2),
gj AS (SELECT 0 AS k, fold, i, j, v FROM gram
       UNION ALL SELECT g.k + 1, g.fold, g.i, g.j, CASE WHEN g.i = g.k THEN g.v / p.v ELSE g.v - r.v * c.v / p.v END
       FROM gj g JOIN gj p ON p.fold = g.fold AND p.i = g.k AND p.j = g.k JOIN gj r ON r.fold = g.fold AND r.i = g.i AND r.j = g.k
         JOIN gj c ON c.fold = g.fold AND c.i = g.k AND c.j = g.j WHERE g.k < {len(PRICE)}),
beta AS (SELECT fold, i, v AS b FROM gj WHERE k = {len(PRICE)} AND j = {len(PRICE)}),
scored AS (SELECT fold, decision_session, ticker, label, sum(v * b) AS prediction FROM filled JOIN beta USING (fold, i) WHERE role = 'test' GROUP BY ALL)""")


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


@query("m1_m9_walk_forward_ridge", recursive(*RIDGE, """
rk AS (SELECT fold, decision_session, rank() OVER (PARTITION BY fold, decision_session ORDER BY prediction) + (count(*) OVER (PARTITION BY fold, decision_session, prediction) - 1) / 2.0 AS rp,
         rank() OVER (PARTITION BY fold, decision_session ORDER BY label) + (count(*) OVER (PARTITION BY fold, decision_session, label) - 1) / 2.0 AS rl FROM scored)""") + """
SELECT fold::INTEGER AS fold, decision_session, corr(rp, rl) AS ic, count(*) AS n FROM rk GROUP BY 1, 2 HAVING count(*) >= 10""", "ic")
def _(spark, d):
    """Out-of-sample ridge on the ranked price block, its calibration, and its skill per fold."""
    p = price_panel(spark, d)
    scored = materialise(fold_ridge.walk_forward_ridge(p, price_folds(p), PRICE), "scored")
    return skill.periodic_ic(calibration.calibrate(scored), by=("fold", "decision_session"))


@query("m9_ridge_predictions", recursive(*RIDGE) + " SELECT fold::INTEGER AS fold, decision_session, ticker, prediction FROM scored", "prediction", 7)
def _(spark, d):
    """Predictions of all folds from one pass over the panel."""
    p = price_panel(spark, d)
    return fold_ridge.walk_forward_ridge(p, price_folds(p), PRICE).select("fold", "decision_session", "ticker", "prediction")


@query("m12_ridge_coefficients", recursive(*RIDGE) + f"""
SELECT fold::INTEGER AS fold, list_extract({PRICE}, i + 1) AS feature, b AS coefficient, abs(b) AS importance FROM beta""", "coefficient importance", 7)
def _(spark, d):
    p = price_panel(spark, d)
    return fold_ridge.coefficient_table(fold_ridge.fit_folds(p, price_folds(p), PRICE), PRICE)


#: Isotonic fit as largest of the smallest means around each score, then lines between fitted scores.
ISOTONIC = (*MQ.BASE, """
pr AS (SELECT ticker, decision_session, fold, floor(prediction * 50) / 50 AS prediction, label FROM preds),
pts AS (SELECT k.k, prediction AS s, sum(label) AS t, count(*)::DOUBLE AS w FROM pr JOIN (SELECT DISTINCT fold AS k FROM pr) k ON fold < k.k WHERE label IS NOT NULL GROUP BY ALL),
ok AS (SELECT k FROM pts GROUP BY 1 HAVING sum(w) >= 400 AND count(*) >= 10),
cum AS (SELECT k, s, row_number() OVER o AS i, sum(t) OVER o AS ct, sum(w) OVER o AS cw, t, w FROM pts JOIN ok USING (k) WINDOW o AS (PARTITION BY k ORDER BY s)),
av AS (SELECT a.k, a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON a.k = b.k AND a.i <= b.i),
lo AS (SELECT k, a, b, min(m) OVER (PARTITION BY k, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM av),
fit AS (SELECT k, b AS i, max(m) AS g FROM lo GROUP BY 1, 2),
nodes AS (SELECT k, s, g FROM fit JOIN cum USING (k, i)),
q AS (SELECT DISTINCT fold AS k, prediction AS s FROM pr),
lower AS (SELECT q.k, q.s, n.s AS s0, n.g AS g0 FROM q ASOF LEFT JOIN nodes n ON q.k = n.k AND q.s >= n.s),
upper AS (SELECT q.k, q.s, n.s AS s1, n.g AS g1 FROM q ASOF LEFT JOIN nodes n ON q.k = n.k AND q.s <= n.s),
val AS (SELECT k, s, CASE WHEN g0 IS NULL THEN g1 WHEN g1 IS NULL OR s0 = s1 THEN g0 ELSE g0 + (s - s0) / (s1 - s0) * (g1 - g0) END AS e FROM lower JOIN upper USING (k, s)),
cal AS (SELECT pr.*, e AS expected_return FROM pr LEFT JOIN val ON k = fold AND s = prediction)""")


def stepped(spark, d):
    """One-week reversal in steps of a fiftieth as the score, so that scores repeat."""
    p = MQ.predictions(spark, d)[0]
    return p.withColumn("prediction", F.floor(F.col("prediction") * 50) / 50)


@query("m10_calibrated_returns", B.with_(*ISOTONIC) + " SELECT fold::INTEGER AS fold, decision_session, ticker, prediction, expected_return FROM cal", "prediction expected_return", 8)
def _(spark, d):
    return calibration.calibrate(stepped(spark, d)).select("fold", "decision_session", "ticker", "prediction", "expected_return")


@query("m11_calibration_table", B.with_(*ISOTONIC, """
c AS (SELECT * FROM cal WHERE expected_return IS NOT NULL AND label IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(expected_return, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM c)""") + """
SELECT greatest(len(list_filter(q, lambda x: x < expected_return)) - 1, 0)::INTEGER AS bucket, count(*) AS n, avg(expected_return) AS predicted, avg(label) AS realised,
       avg(expected_return) - avg(label) AS error FROM c, e GROUP BY 1""", "predicted realised error")
def _(spark, d):
    return calibration.calibration_table(materialise(calibration.calibrate(stepped(spark, d)), "calibrated"))


#: Weeks each name is held, its costs, and performance by scenario, from a table ``{0}`` of (scenario, decision_session, ticker, weight).
def ledger_sql(books: str, weeks: str, reported: str | None = None) -> list[str]:
    f = costs.INDIA
    side = "CASE WHEN fut THEN CASE WHEN ch > 0 THEN {0} ELSE {1} END ELSE CASE WHEN ch > 0 THEN {2} ELSE {3} END END"
    tax = side.format(f.futures_stamp, f.futures_tax_sell, f.tax_buy + f.stamp, f.tax_sell + f.regulatory_sell)
    return [f"""
wo AS (SELECT scenario, decision_session AS d, lead(decision_session) OVER (PARTITION BY scenario ORDER BY decision_session) AS nxt FROM (SELECT DISTINCT decision_session FROM {weeks}), (SELECT DISTINCT scenario FROM {books})),
mv AS (SELECT scenario, d AS decision_session, ticker, sum(w1) AS w1, sum(w0) AS w0 FROM (
         SELECT scenario, decision_session AS d, ticker, weight AS w1, 0.0::DOUBLE AS w0 FROM {books}
         UNION ALL SELECT b.scenario, nxt, ticker, 0.0::DOUBLE, weight FROM {books} b JOIN wo ON wo.scenario = b.scenario AND wo.d = b.decision_session WHERE nxt IS NOT NULL) GROUP BY ALL),
mc AS (SELECT mv.*, w1 - w0 AS ch, CASE WHEN abs(w1 - w0) >= 1e-9 THEN abs(w1 - w0) ELSE 0 END AS n, w1 < 0 OR w0 < 0 AS fut, volatility, adv_notional, hl_range
       FROM mv LEFT JOIN stats USING (ticker, decision_session)),
ct AS (SELECT *, n * CASE WHEN fut THEN {f.futures_commission} ELSE {f.commission} END * 1e-4 AS com, n * CASE WHEN fut THEN {f.futures_exchange} ELSE {f.exchange} END * 1e-4 AS exc FROM mc),
cc AS (SELECT scenario, decision_session, sum(CASE WHEN n > 0 THEN com ELSE 0 END) AS commission, sum(CASE WHEN n > 0 THEN n * ({tax}) * 1e-4 + exc + (com + exc) * {f.gst_rate} ELSE 0 END) AS taxes,
         sum(CASE WHEN n > 0 THEN n * CASE WHEN hl_range > 0 THEN greatest({f.min_half_spread}::DOUBLE, least(hl_range * 10000 * {f.spread_from_range}, 50)) ELSE {f.min_half_spread} END * 1e-4 ELSE 0 END) AS spread,
         sum(CASE WHEN n > 0 AND adv_notional > 0 THEN n * {f.impact_k} * coalesce(volatility, 0.3) / sqrt(252.0) * 10000 * sqrt(least(n / adv_notional, 1)) * 1e-4 ELSE 0 END) AS impact,
         sum(CASE WHEN w1 < 0 THEN -w1 ELSE 0 END) * {f.borrow_annual} * 1e-4 / 252 * 5 AS borrow, 0.0::DOUBLE AS roll, sum(abs(ch)) / 2 AS turnover FROM ct GROUP BY 1, 2),
cost AS (SELECT *, commission + taxes + spread + impact + borrow + roll AS total FROM cc)""", f"""
gr AS (SELECT scenario, decision_session, sum(weight * coalesce(forward_return, 0)) AS gross_return, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure
       FROM {books} LEFT JOIN fwd USING (decision_session, ticker) GROUP BY 1, 2),
lg AS (SELECT scenario, decision_session, coalesce(gross_return, 0) AS gross_return, coalesce(total, 0) AS cost, coalesce(gross_return, 0) - coalesce(total, 0) AS net_return,
         coalesce(turnover, 0) AS turnover, coalesce(gross_exposure, 0) AS gross_exposure, coalesce(net_exposure, 0) AS net_exposure
       FROM (SELECT DISTINCT scenario, decision_session FROM {reported or weeks}) LEFT JOIN gr USING (scenario, decision_session) LEFT JOIN cost USING (scenario, decision_session))"""]


FORWARD = "\nfwd AS (SELECT decision_session, ticker, open_out / open_in - 1 AS forward_return FROM pairs WHERE open_in > 0)"
METRICS = """
eq AS (SELECT *, product(1 + net_return) OVER (PARTITION BY scenario ORDER BY decision_session) AS eq FROM {0}),
ud AS (SELECT *, eq / max(eq) OVER (PARTITION BY scenario ORDER BY decision_session) - 1 AS dd FROM eq),
ur AS (SELECT *, count(*) FILTER (dd >= -1e-9) OVER (PARTITION BY scenario ORDER BY decision_session) AS run FROM ud),
uw AS (SELECT scenario, max(k) AS weeks FROM (SELECT scenario, run, count(*) AS k FROM ur WHERE dd < -1e-9 GROUP BY 1, 2) GROUP BY 1),
me AS (SELECT scenario, count(*) AS n_periods, product(1 + net_return) AS e, avg(net_return) * 52 AS ann_return, stddev_samp(net_return) * sqrt(52.0) AS ann_vol,
         stddev_samp(net_return) FILTER (net_return < 0) * sqrt(52.0) AS down, min(dd) AS max_drawdown, avg((net_return > 0)::INTEGER) AS hit_rate, avg(net_return) FILTER (net_return > 0) AS win,
         avg(net_return) FILTER (net_return < 0) AS loss, max(net_return) AS best_week, min(net_return) AS worst_week, avg(turnover) AS turnover,
         avg(cost) * 10000 AS cost_drag_bps, avg(gross_exposure) AS avg_gross, avg(net_exposure) AS avg_net,
         CASE WHEN count(*) > 3 THEN coalesce(skewness(net_return), 0) ELSE 0 END AS skew FROM ud GROUP BY 1),
mt AS (SELECT scenario, n_periods, e - 1 AS total_return, pow(e, 52.0 / n_periods) - 1 AS cagr, ann_return, ann_vol, CASE WHEN abs(ann_vol) > 1e-12 THEN ann_return / ann_vol ELSE 0 END AS sharpe,
         CASE WHEN abs(down) > 1e-12 THEN ann_return / down ELSE 0 END AS sortino, CASE WHEN abs(max_drawdown) > 1e-9 THEN (pow(e, 52.0 / n_periods) - 1) / abs(max_drawdown) ELSE 0 END AS calmar,
         max_drawdown, coalesce(weeks, 0) AS max_drawdown_weeks, hit_rate, coalesce(win / abs(loss), 0) AS win_loss_ratio, best_week, worst_week, skew, turnover, cost_drag_bps, avg_gross, avg_net
       FROM me LEFT JOIN uw USING (scenario))"""
METRIC_COLUMNS = ["scenario", "n_periods", "total_return", "cagr", "ann_return", "ann_vol", "sharpe", "sortino", "calmar", "max_drawdown", "max_drawdown_weeks", "hit_rate", "win_loss_ratio",
                  "best_week", "worst_week", "skew", "turnover", "cost_drag_bps", "avg_gross", "avg_net"]
METRIC_DOUBLES = " ".join(c for c in METRIC_COLUMNS if c not in ("scenario", "n_periods", "max_drawdown_weeks"))

VARIANT_SQL = (*RIDGE, MQ.STATS, FORWARD, """
usable AS (SELECT fold FROM rows WHERE role = 'train' GROUP BY 1 HAVING count(*) >= 200),
tested AS (SELECT rows.* FROM rows JOIN usable USING (fold) WHERE role = 'test'),
vp AS (SELECT 'zero' AS scenario, fold, decision_session, ticker, label, 0.0::DOUBLE AS prediction FROM tested
       UNION ALL SELECT 'momentum', fold, decision_session, ticker, label, 0.5 * coalesce(reversal_1w, 0) + 0.3 * coalesce(mom_12w, 0) + 0.2 * coalesce(mom_52w_skip4w, 0) FROM tested
       UNION ALL SELECT 'price_only', fold, decision_session, ticker, label, prediction FROM scored JOIN usable USING (fold)),
vs AS (SELECT scenario, decision_session, ticker, prediction - avg(prediction) OVER (PARTITION BY scenario, decision_session) AS score FROM vp),
vn AS (SELECT *, count(*) OVER p AS n, row_number() OVER (p ORDER BY score DESC, ticker) AS rt, row_number() OVER (p ORDER BY score, ticker DESC) AS rb FROM vs WINDOW p AS (PARTITION BY scenario, decision_session)),
vb AS (SELECT scenario, decision_session, ticker, sign(score) / sum(abs(sign(score))) OVER (PARTITION BY scenario, decision_session) AS weight FROM vn
       WHERE (score > 1e-12 AND rt <= CASE WHEN n < 30 THEN least(8, greatest(1, n // 4)) ELSE 8 END) OR (score < -1e-12 AND rb <= CASE WHEN n < 30 THEN least(7, greatest(1, n // 4)) ELSE 7 END))""",
               *ledger_sql("vb", "vp"))


def plain_books(scores):
    """Equal weights on the selected names; scores that differ from the mean by rounding alone are none."""
    s = scores.withColumn("score", F.when(F.abs("score") > 1e-12, F.col("score")).otherwise(0.0))
    return book.equal_weights(book.select_names(s, by=("scenario", "decision_session")), by=("scenario", "decision_session"))


def decision_stats(bars, grid):
    """Trailing statistics of the decision rows; the daily rows stay where they are."""
    marks = grid.select(F.col("decision_session").alias("session"))
    return performance.trailing_stats(bars, marks).withColumnRenamed("session", "decision_session")


def variants_of(spark, d, variants, **options):
    bars, _, grid = FQ.setup(spark, d)
    p = panel_of(bars, grid)
    made = materialise(ablation.variant_predictions(p, price_folds(p), PRICE, variants=variants, **options), "variants")
    stats = decision_stats(bars, grid)
    return made, labels.forward_returns(bars, grid), stats


@query("v20_fixed_variants", recursive(*VARIANT_SQL, METRICS.format("lg")) + f" SELECT {', '.join(METRIC_COLUMNS)} FROM mt", METRIC_DOUBLES, 6)
def _(spark, d):
    """Zero, momentum and ridge on identical folds: books, costs and performance in one plan."""
    made, forward, stats = variants_of(spark, d, ("zero", "momentum", "price_only"))
    return ablation.ablation(made, forward, stats, costs.INDIA, size=plain_books, hold=False)[1].select(*METRIC_COLUMNS)


@query("v20_variant_ledger", recursive(*VARIANT_SQL) + """
SELECT scenario, decision_session, gross_return, cost, turnover, gross_exposure, net_exposure FROM lg""", "gross_return cost turnover gross_exposure net_exposure", 8)
def _(spark, d):
    made, forward, stats = variants_of(spark, d, ("zero", "momentum", "price_only"))
    return ablation.ablation(made, forward, stats, costs.INDIA, size=plain_books, hold=False)[0].select(
        "scenario", "decision_session", "gross_return", "cost", "turnover", "gross_exposure", "net_exposure")


@query("v20_ablation")
def _(spark, d):
    """All eight variants on identical folds; two features stand in for news, on one name in three."""
    bars, _, grid = FQ.setup(spark, d)
    p = panel_of(bars, grid)
    some = F.expr("cast(substring(ticker, 2, 20) as bigint) % 3 = 0")
    p = materialise(p.withColumns({"news_a": F.when(some, F.col("mom_4w")), "news_b": F.when(some, F.col("gap_1d"))}), "panel")
    made = materialise(ablation.variant_predictions(p, price_folds(p), PRICE, ("news_a", "news_b")), "variants")
    stats = decision_stats(bars, grid)
    _, metrics = ablation.ablation(made, labels.forward_returns(bars, grid), stats, costs.INDIA)
    return metrics.join(ablation.variant_skill(made).select("scenario", "mean_ic", "fold_ic", "fold_t"), "scenario", "left")


CPCV = f"""
known AS (SELECT * FROM panel WHERE label IS NOT NULL),
wk AS (SELECT decision_session, row_number() OVER (ORDER BY decision_session) - 1 AS week, count(*) OVER () AS n FROM (SELECT DISTINCT decision_session FROM known)),
gp AS (SELECT decision_session, CASE WHEN week < (n % 6) * (n // 6 + 1) THEN week // (n // 6 + 1) ELSE n % 6 + (week - (n % 6) * (n // 6 + 1)) // (n // 6) END AS g FROM wk),
pick AS (SELECT row_number() OVER (ORDER BY a.range, b.range) - 1 AS fold, a.range AS a, b.range AS b FROM range(6) a JOIN range(6) b ON a.range < b.range),
rw AS (SELECT fold, g = a OR g = b AS tested, known.* FROM gp JOIN known USING (decision_session) JOIN pick ON TRUE),
sp AS (SELECT fold, min(label_t0) AS lo, max(label_t1) AS hi FROM rw WHERE tested GROUP BY 1),
rows AS (SELECT CASE WHEN tested THEN 'test' WHEN label_t0 <= hi AND label_t1 >= lo THEN 'purged'
           WHEN (label_t1 >= lo - 7 AND label_t1 < lo) OR (label_t0 > hi AND label_t0 <= hi + 7) THEN 'embargoed' ELSE 'train' END AS role, rw.* FROM rw JOIN sp USING (fold)),
okp AS (SELECT fold FROM rows GROUP BY 1 HAVING count(*) FILTER (role = 'train') >= 200 AND count(*) FILTER (role = 'test') >= 50)"""
CANDIDATES = ["mom_4w", "reversal_1w", "mom_12w", "vol_13w"]


@query("v19_path_scores", B.with_(*PANEL, CPCV, f"""
cand AS (SELECT fold, role, decision_session, ticker, label, unnest({CANDIDATES}) AS candidate, unnest([{', '.join(CANDIDATES)}]) AS v FROM rows JOIN okp USING (fold) WHERE role IN ('train', 'test')),
ck AS (SELECT *, rank() OVER (PARTITION BY fold, role, candidate, decision_session ORDER BY v) + (count(*) OVER (PARTITION BY fold, role, candidate, decision_session, v) - 1) / 2.0 AS rp,
         rank() OVER (PARTITION BY fold, role, candidate, decision_session ORDER BY label) + (count(*) OVER (PARTITION BY fold, role, candidate, decision_session, label) - 1) / 2.0 AS rl FROM cand WHERE v IS NOT NULL),
ci AS (SELECT fold, role, candidate, decision_session, corr(rp, rl) AS ic FROM ck GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT v) >= 3 AND count(DISTINCT label) >= 2)""") + """
SELECT fold::INTEGER AS path, candidate, avg(ic) FILTER (role = 'train') AS in_sample, avg(ic) FILTER (role = 'test') AS out_of_sample FROM ci GROUP BY 1, 2""", "in_sample out_of_sample", 8)
def _(spark, d):
    """Four factors on every combinatorial path; a week's correlation is computed once for each set of its rows."""
    p = price_panel(spark, d)
    folds = materialise(splits.combinatorial_folds(p.filter("label is not null"), n_groups=6, n_test_groups=2, embargo_weeks=1), "folds")
    return ablation.path_skill(p, folds, CANDIDATES)


@query("m5_shuffled_labels", B.with_(*FQ.LABEL_BASE) + """
SELECT decision_session, count(*) AS n, sum(label) AS total, min(label) AS least, max(label) AS most, median(label) AS middle FROM labels GROUP BY 1""", "total least most middle", 8)
def _(spark, d):
    """Labels permuted within each week keep the week's values."""
    bars, _, grid = FQ.setup(spark, d)
    mixed = models.shuffle_labels(labels.build_labels(bars, grid))
    return mixed.groupBy("decision_session").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.min("label").alias("least"), F.max("label").alias("most"),
                                                 F.median("label").alias("middle"))


NAMED_BOOK = (*MQ.BASE, MQ.PICK, MQ.STATS, MQ.INVVOL, FORWARD, """
bk AS (SELECT 'book' AS scenario, decision_session, ticker, weight FROM weighted)""", *ledger_sql("bk", "grid", "(SELECT scenario, decision_session FROM bk UNION SELECT scenario, decision_session FROM cost)"), """
bo AS (SELECT scenario, decision_session, net_return, cost, turnover, gross_exposure, net_exposure FROM lg
         UNION ALL SELECT 'hold', decision_session, avg(forward_return), NULL, NULL, NULL, NULL FROM bk JOIN fwd USING (decision_session, ticker) GROUP BY 2)""")

LARGE = ("total_return", "cagr", "calmar")


@query("b4_v7_book_performance", B.with_(*NAMED_BOOK, METRICS.format("bo")) + f"""
SELECT * REPLACE ({', '.join(f'sign({c}) * ln(1 + abs({c})) AS {c}' for c in LARGE)}) FROM (SELECT {', '.join(METRIC_COLUMNS)} FROM mt)""", METRIC_DOUBLES, 6)
def _(spark, d):
    """Metrics of the inverse-volatility book after costs, and of holding everything; figures that compound to any size as logarithms."""
    return MQ.performance_report(spark, d).withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in LARGE})


@query("c5_c7_rebalance_cost", B.with_(*NAMED_BOOK) + """
SELECT decision_session, commission, taxes, spread, impact, borrow, roll, total, turnover FROM cost""", "commission taxes spread impact borrow roll total turnover", 9)
def _(spark, d):
    """Cost components and turnover of the inverse-volatility book, week by week."""
    b, _, grid, stats = MQ.sized(spark, d)
    return costs.rebalance_cost(b.select("decision_session", "ticker", "weight"), grid, stats, costs.INDIA)


#: Volatility under the covariance shrunk to constant correlation, pair by pair.
TARGET_VOL = (*MQ.BASE, MQ.PICK, MQ.STATS, MQ.INVVOL, """
wkd AS (SELECT session AS s, min(d.decision_session) AS e FROM sessions JOIN decisions d ON d.decision_session >= session GROUP BY 1),
wb AS (SELECT ticker, e AS session, arg_max("close", bars.session) AS "close" FROM bars JOIN wkd ON s = bars.session GROUP BY 1, 2),
wi AS (SELECT session, row_number() OVER (ORDER BY session) AS i, lag(session) OVER (ORDER BY session) AS prev FROM (SELECT DISTINCT session FROM wb)),
wr AS (SELECT ticker, session, i, CASE WHEN lag(session) OVER t = prev THEN "close" / lag("close") OVER t - 1 END AS r FROM wb JOIN wi USING (session) WINDOW t AS (PARTITION BY ticker ORDER BY session)),
li AS (SELECT decision_session, max(i) AS i FROM (SELECT DISTINCT decision_session FROM weighted) JOIN wi ON session <= decision_session GROUP BY 1),
pa AS (SELECT w.decision_session, w.ticker, weight, wr.session, r FROM weighted w JOIN li USING (decision_session) JOIN wr ON wr.ticker = w.ticker AND wr.i BETWEEN li.i - 103 AND li.i WHERE r IS NOT NULL),
nn AS (SELECT decision_session, count(DISTINCT ticker) AS n FROM pa GROUP BY 1),
fu AS (SELECT decision_session, session FROM pa JOIN nn USING (decision_session) GROUP BY decision_session, session, n HAVING count(*) = n),
hi AS (SELECT pa.* FROM pa JOIN fu USING (decision_session, session)),
cv AS (SELECT decision_session, a.ticker AS x, b.ticker AS y, any_value(a.weight) AS wx, any_value(b.weight) AS wy, covar_samp(a.r, b.r) AS c, stddev_samp(a.r) AS sx, stddev_samp(b.r) AS sy, count(*) AS t
       FROM hi a JOIN hi b USING (decision_session, session) GROUP BY 1, 2, 3),
mr AS (SELECT decision_session, avg(coalesce(c / nullif(sx * sy, 0), 0)) FILTER (x <> y) AS m FROM cv GROUP BY 1),
pv2 AS (SELECT decision_session, sqrt(greatest(sum(wx * wy * (k * CASE WHEN x = y THEN c ELSE m * sx * sy END + (1 - k) * c)), 0)) * sqrt(52.0) AS v
        FROM (SELECT *, least(greatest(n / greatest(t, 1)::DOUBLE, 0.1), 0.9) AS k FROM cv JOIN mr USING (decision_session) JOIN nn USING (decision_session)) WHERE t >= 10 AND n >= 2 GROUP BY 1),
al AS (SELECT decision_session, sqrt(sum(pow(weight * coalesce(volatility, m), 2))) AS a FROM (SELECT *, median(volatility) OVER (PARTITION BY decision_session) AS m FROM (SELECT decision_session, ticker, weight, volatility FROM weighted)) GROUP BY 1),
sz AS (SELECT decision_session, CASE WHEN coalesce(v, 0) > 1e-6 THEN v ELSE a END AS cur FROM al LEFT JOIN pv2 USING (decision_session))""")


@query("b2_simple_weekly_returns", B.with_(*TARGET_VOL) + " SELECT ticker, session, r AS weekly_return FROM wr", "weekly_return")
def _(spark, d):
    from tidemark.operators.calendar import simple_weekly_returns
    from tidemark.sources import fixtures as fx

    return simple_weekly_returns(fx.bars(spark, d))


query("p5_p7_target_vol_book", B.with_(*TARGET_VOL) + """
SELECT decision_session, ticker, weight * s AS weight, s AS vol_scale FROM weighted JOIN (
  SELECT decision_session, coalesce(CASE WHEN cur > 1e-6 THEN least(greatest(0.12::DOUBLE / cur, 1 / 3.0::DOUBLE), 3.0::DOUBLE) END, 1) AS s FROM sz) USING (decision_session)""", "weight vol_scale", 8)(MQ.target_vol_book)


query("o1_o4_orders", B.with_(*MQ.BASE, MQ.PICK, MQ.STATS, MQ.INVVOL, """
px AS (SELECT ticker, arg_max("close", session) AS price FROM bars GROUP BY 1),
od AS (SELECT ticker, CASE WHEN weight > 0 THEN 'buy' ELSE 'sell' END AS side, floor(abs(weight) * 1e6 / price) AS quantity, CASE WHEN weight >= 0 THEN 'equity' ELSE 'equity_short' END AS instrument,
         price AS est_price, floor(abs(weight) * 1e6 / price) * price AS est_value FROM weighted JOIN px USING (ticker)
       WHERE decision_session = (SELECT max(decision_session) FROM weighted) AND floor(abs(weight) * 1e6 / price) >= 1),
st AS (SELECT *, CASE WHEN instrument = 'equity_short' THEN CASE side WHEN 'sell' THEN 'open_short' ELSE 'close' END WHEN side = 'sell' THEN 'reduce' ELSE 'open_long' END AS step FROM od)""") + """
SELECT ticker, side, quantity, instrument, est_price, est_value, '' AS tag, FALSE AS below_one_lot, TRUE AS is_order, step,
       row_number() OVER (ORDER BY CASE step WHEN 'close' THEN 0 WHEN 'reduce' THEN 1 WHEN 'open_short' THEN 2 ELSE 3 END, est_value DESC, ticker)::INTEGER AS position,
       CASE step WHEN 'open_long' THEN -est_value WHEN 'open_short' THEN 0 ELSE est_value END AS cash_effect FROM st""", "quantity est_price est_value cash_effect", 3)(MQ.newest_orders)

#: Student's t tail by Simpson's rule over the density; the normal probability by its series.
T_TAIL = """(1 - 2 * exp(lgamma((n_periods) / 2.0) - lgamma((n_periods - 1) / 2.0)) / sqrt((n_periods - 1) * pi()) * abs(t_stat) / 6000 * list_sum(list_transform(range(0, 2001),
  lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t_stat * i / 2000.0, 2) / (n_periods - 1), -n_periods / 2.0))))"""


def normal_sql(x: str) -> str:
    return (f"(0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 220), lambda k: "
            f"exp((2 * k + 1) * ln(abs({x}) + 1e-300) - lgamma(2 * k + 3) + (k + 1) * ln(2.0) + lgamma(k + 2)))))")


query("v2_ic_verdict", B.with_(*MQ.BASE, f"s AS (SELECT {MQ.IC_STATS} FROM ic)", f"p AS (SELECT *, {T_TAIL} AS p_value FROM s)") + """
SELECT *, CASE WHEN n_periods < 52 THEN 'too few weeks' WHEN p_value > 0.10 THEN 'noise' WHEN abs(mean_ic) < 0.01 THEN 'detectable but tiny' WHEN abs(mean_ic) < 0.03 THEN 'plausible'
  ELSE 'unusually strong' END AS verdict FROM p""", MQ.IC_DOUBLES + " p_value")(MQ.ic_verdict)


TRIALS = """
tn AS (SELECT n_name AS market, count(DISTINCT p_brand) * 40 AS n_trials, count(*) AS n_observations, avg(l_discount) * 40 AS observed FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1),
bi AS (SELECT market, n_trials, 0 AS step, q, 0.0::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM (SELECT *, unnest([1.0::DOUBLE / n_trials, 1.0::DOUBLE / (n_trials * exp(1.0))]) AS q FROM tn)
       UNION ALL SELECT market, n_trials, step + 1, q, CASE WHEN {up} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {up} THEN hi ELSE (lo + hi) / 2 END FROM bi WHERE step < 48),
zz AS (SELECT market, max((lo + hi) / 2) FILTER (q = 1.0::DOUBLE / n_trials) AS z1, max((lo + hi) / 2) FILTER (q < 1.0::DOUBLE / n_trials) AS z2 FROM bi WHERE step = 48 GROUP BY 1),
mx AS (SELECT market, n_trials, observed, n_observations, (1 - 0.5772156649015329::DOUBLE) * z1 + 0.5772156649015329::DOUBLE * z2 AS expected_max_sharpe FROM tn JOIN zz USING (market))""".replace(
    "{up}", "1 - " + normal_sql("((lo + hi) / 2)") + " > q")


@query("v12_expected_best_of_trials", recursive(TRIALS) + """
SELECT market, n_trials, expected_max_sharpe, CASE WHEN n_observations >= 20 THEN greatest(0, observed - expected_max_sharpe) ELSE 0 END AS haircut FROM mx""", "expected_max_sharpe haircut", 7)
def _(spark, d):
    """Best Sharpe that as many worthless trials would show, and what is left of the observed one."""
    from tidemark.functions import distributions as D
    from tidemark.sources import fixtures as fx

    li, s, n, p = (fx.table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    made = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey).groupBy(F.col("n_name").alias("market")).agg(
        (F.count_distinct("p_brand") * 40).alias("n_trials"), F.count("*").alias("n_observations"), (F.avg("l_discount") * 40).alias("observed"))
    return made.select("market", "n_trials", D.expected_max_sharpe_col("n_trials").alias("expected_max_sharpe"), D.haircut_sharpe_col("observed", "n_trials", "n_observations").alias("haircut"))


#: Expected best of twelve worthless trials; ``v12`` holds this statistic against SQL.
BAR = expected_max_sharpe(12)


@query("v13_deflated_sharpe", B.with_(EQ.LEDGER, f"""
m AS (SELECT scenario, count(*) AS n_observations, avg(gross_return - cost) / stddev_samp(gross_return - cost) AS sr, skewness(gross_return - cost) AS skew, kurtosis(gross_return - cost) + 3 AS kurtosis FROM ledger GROUP BY 1),
z AS (SELECT *, (sr - {BAR!r}::DOUBLE / sqrt(52.0)) * sqrt(n_observations - 1) / sqrt(greatest(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr, 1e-9)) AS deflated_sharpe FROM m),
p AS (SELECT *, {normal_sql('deflated_sharpe')} AS probability FROM z)""") + f"""
SELECT scenario, n_observations, skew, kurtosis, sr * sqrt(52.0) AS observed_sharpe, {BAR!r}::DOUBLE AS expected_max_sharpe, deflated_sharpe, probability,
       CASE WHEN n_observations < 100 THEN 'too short' WHEN probability >= 0.95 THEN 'survives' WHEN probability >= 0.8 THEN 'marginal' ELSE 'does not survive' END AS verdict FROM p""",
       "skew kurtosis observed_sharpe expected_max_sharpe deflated_sharpe probability")
def _(spark, d):
    return performance.deflated_sharpe(EQ.ledger(spark, d), 12)


#: Events spread over the bars' period: sixteen days of bars for each day of events, on twenty of the names.
SPREAD_OUT = NQ.ANALYSES.replace("'U' || user_id % 20", "'S' || (user_id % 20 + 1)").replace(
    "ts AS available_at", "TIMESTAMP '2000-01-03' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 16) AS available_at")
NEWS = [f"news_{c}" if not c.startswith("news_") else c for c in NQ.nf.FEATURES]
_NEWS_CTES = [c for c in NQ.news_sql("decisions_unused AS (SELECT 1)") if "sessions AS" not in c and "decisions_unused" not in c][1:]


@query("x6_panel_with_news", B.with_(
    B.BARS, B.SESSIONS, B.decisions(), B.grid(), B.MEMBERSHIP, FQ.LABELS, SPREAD_OUT, *_NEWS_CTES, f"""
rounded AS (SELECT decision_session, ticker, {', '.join(f"round({'least(' + c + ', 180)' if c.endswith('since_material') else c}, 9) AS {c}" for c in NEWS)} FROM news),
ats AS (SELECT bars.ticker, decision_session FROM bars JOIN grid ON decision_session = session),
joined AS (SELECT ats.*, sector, label, rounded.* EXCLUDE (decision_session, ticker) FROM ats JOIN universe ON universe.ticker = ats.ticker
             AND decision_session BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31')
           LEFT JOIN rounded ON rounded.ticker = ats.ticker AND rounded.decision_session = ats.decision_session
           LEFT JOIN labels ON labels.ticker = ats.ticker AND labels.decision_session = ats.decision_session),
sized AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY decision_session) AS names FROM joined) WHERE names >= 5)""") + f"""
SELECT decision_session, ticker, sector, label, {', '.join(FQ.rank_sql(c) for c in NEWS)} FROM sized""", "label " + " ".join(NEWS))
def _(spark, d):
    """The panel's news side: features of spread-out events at each decision, joined, then ranked."""
    from tidemark.operators import calendar as cal
    from tidemark.operators import universe
    from tidemark.sources import fixtures as fx

    bars, sessions, grid = FQ.setup(spark, d)
    an = fx.analyses(spark, d)
    start, origin = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("2000-01-03", "2024-01-01"))
    an = an.withColumns({"ticker": F.concat(F.lit("S"), (F.substring("ticker", 2, 9).cast("int") + 1).cast("string")),
                         "available_at": F.timestamp_micros((F.unix_micros("available_at") - origin) * 16 + start)})
    news = NQ.nf.build_news_features(an, cal.all_decisions(sessions))
    news = materialise(news.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in NEWS}), "news")
    made = P.build_panel(bars, grid, membership=universe.membership_panel(fx.membership(spark, d), sessions), labels=labels.build_labels(bars, grid), news=news,
                         min_names=FQ.MIN_NAMES, blocks=("price",), wanted=())
    return made.select("decision_session", "ticker", "sector", "label", *NEWS)


@query("u3_batch_analyzer", """
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'repeated' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 7 <> 0 THEN doc_id * 0.5::DOUBLE END AS sentiment FROM documents
UNION ALL SELECT 'x' || doc_id, 'unasked', 0.0::DOUBLE FROM documents WHERE doc_id % 13 = 0""", "sentiment")
def _(spark, d):
    """An analyzer that answers backwards, skips some articles, answers others twice and some that nobody asked about."""
    from tidemark.operators.analysis import with_batch_analyzer
    from tidemark.sources import fixtures as fx

    def answers(batch):
        import pandas as pd

        ids = batch["id"].astype(int).iloc[::-1]
        kept = ids[ids % 7 != 0]
        keys = [*kept.astype(str), *kept[kept % 11 == 0].astype(str), *("x" + ids[ids % 13 == 0].astype(str))]
        tone = [*(kept * 0.5), *(kept[kept % 11 == 0] * 9.0), *[0.0] * int((ids % 13 == 0).sum())]
        return pd.DataFrame({"id": keys, "sentiment": tone})

    asked = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return with_batch_analyzer(asked, answers, ["sentiment"], key="id").select("id", "status", "sentiment")


@query("v6_ic_by_sector", B.with_(*MQ.BASE, B.MEMBERSHIP, f"""
sp6 AS (SELECT preds.*, sector FROM preds JOIN universe USING (ticker) WHERE label IS NOT NULL),
rk6 AS (SELECT *, rank() OVER (p ORDER BY prediction) + (count(*) OVER (PARTITION BY sector, decision_session, prediction) - 1) / 2.0 AS rp,
          rank() OVER (p ORDER BY label) + (count(*) OVER (PARTITION BY sector, decision_session, label) - 1) / 2.0 AS rl FROM sp6 WINDOW p AS (PARTITION BY sector, decision_session)),
ic6 AS (SELECT sector, decision_session, CASE WHEN abs(corr(rp, rl)) > 1e-12 THEN corr(rp, rl) ELSE 0 END AS ic FROM rk6 GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT prediction) > 1 AND count(DISTINCT label) > 1)""") + f"""
SELECT sector, {MQ.IC_STATS.replace('avg(ic) / stddev_samp(ic) AS ic_ir', 'CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS ic_ir').replace('avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat', 'CASE WHEN stddev_samp(ic) > 1e-12 AND count(*) > 2 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(*))) ELSE 0 END AS t_stat')}
FROM ic6 GROUP BY 1""", MQ.IC_DOUBLES)
def _(spark, d):
    from tidemark.operators import universe
    from tidemark.sources import fixtures as fx

    p = MQ.predictions(spark, d)[0].join(universe.sectors(fx.membership(spark, d)), "ticker")
    return skill.ic_by_group(p, "sector", min_names=4)


@query("v23_rolling_ic", B.with_(*MQ.BASE) + """
SELECT decision_session, CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END AS rolling_ic FROM ic WINDOW w AS (ORDER BY decision_session ROWS 25 PRECEDING)""", "rolling_ic")
def _(spark, d):
    return skill.rolling_ic(skill.periodic_ic(MQ.predictions(spark, d)[0])).select("decision_session", "rolling_ic")


@query("p8_kelly_cap", B.with_(*MQ.BASE, MQ.PICK, MQ.STATS, MQ.INVVOL, """
kv AS (SELECT *, median(volatility) OVER (PARTITION BY decision_session) AS md FROM (SELECT decision_session, ticker, weight, score, volatility FROM weighted))""") + """
SELECT decision_session, ticker, sign(weight) * CASE WHEN md IS NULL THEN abs(weight) ELSE least(abs(weight), least(abs(score * 0.01 / pow(greatest(coalesce(volatility, md), 0.001), 2)) * 0.25, 1)) END AS weight
FROM kv""", "weight", 9)
def _(spark, d):
    """Quarter-Kelly ceilings where a hundredth of the score is the expected return."""
    b, *_ = MQ.sized(spark, d)
    return book.kelly_cap(b.withColumn("expected_return", F.col("score") * 0.01)).select("decision_session", "ticker", "weight")


@query("v17_planted_overlap", B.with_(*FQ.LABEL_BASE, MQ.FOLDS, """
sp7 AS (SELECT fold, min(label_t0) AS lo, max(label_t1) AS hi FROM folds JOIN labels USING (decision_session, ticker) WHERE role = 'test' GROUP BY 1)""") + """
SELECT fold::INTEGER AS fold, count(*) FILTER (label_t0 <= hi AND label_t1 >= lo) AS n_overlapping, count(*) FILTER (label_t1 >= lo - 7 AND label_t1 < lo) AS n_in_embargo
FROM folds JOIN labels USING (decision_session, ticker) JOIN sp7 USING (fold) WHERE role <> 'test' GROUP BY 1""")
def _(spark, d):
    """What the report finds where purged and embargoed rows are put back into training."""
    folds = splits.walk_forward_folds(MQ._labels(spark, d), embargo_weeks=1, **MQ.WF)
    leaky = folds.withColumn("role", F.when(F.col("role") == "test", "test").otherwise("train"))
    return splits.overlap_report(leaky, embargo_weeks=1)


@query("v24_all_features", B.with_(B.BARS) + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(*) AS n_compared, 0::BIGINT AS n_different FROM bars WHERE session = DATE '2000-10-06' """ for c in FQ.PANEL_COLS))
def _(spark, d):
    """All 63 features at a cut-off, from the full and from the truncated history."""
    from tidemark.sources import fixtures as fx

    return splits.lookahead_differences(fx.bars(spark, d), "2000-10-06", list(FQ.PANEL_COLS))


@query("m2_boosted_trees", B.with_(*PANEL, "known AS (SELECT * FROM panel WHERE label IS NOT NULL)") + """
SELECT n_trees::INTEGER AS n_trees, count(*) AS n, avg(label) AS mean_prediction, TRUE AS loss_fell FROM known, (SELECT unnest([1, 3]) AS n_trees) GROUP BY 1""", "mean_prediction", 9)
def _(spark, d):
    """Without penalty and at full rate the mean prediction is the mean label after every tree, and more trees fit better."""
    p = price_panel(spark, d).where("label is not null")
    out, before = None, p.agg(F.var_pop("label")).first()[0]
    for n in (1, 3):
        fitted = models.boosted_trees(p, PRICE[:6], trees=n, rate=1.0, penalty=0.0, rows=1.0, features=1.1, leaves=6, depth=3)
        one = fitted.predict(p).agg(F.lit(n).alias("n_trees"), F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction"),
                                    (F.avg((F.col("label") - F.col("prediction")) ** 2) < before).alias("loss_fell"))
        out = one if out is None else out.union(one)
    return out


@query("m2_trees_out_of_sample")
def _(spark, d):
    """Boosted trees walked forward over the folds of the ridge, next to it: weekly rank correlation of both."""
    p = price_panel(spark, d)
    folds = price_folds(p)
    ridge = fold_ridge.walk_forward_ridge(p, folds, PRICE).select("fold", "decision_session", "ticker", "label", "prediction", F.lit("ridge").alias("model"))
    trees = models.walk_forward_predict(p, folds, lambda train, _: models.boosted_trees(train, PRICE, trees=6, rate=0.3).predict)
    both = materialise(ridge.unionByName(trees.withColumn("model", F.lit("trees")).select(ridge.columns)), "scored")
    return skill.ic_statistics(skill.periodic_ic(both, by=("model", "decision_session")), ("model",))
