"""Questions asked of finished predictions and ledgers: one decision, blocks of a blend, paths, costs, verdicts."""

import json
from collections.abc import Callable
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.functions.exprs import div
from tidemark.operators import performance, skill
from tidemark.operators.models import Fitted

# Weeks a saved model stays usable; labels a path needs to be scored; limits of the verdict rules.
MAX_MODEL_AGE_WEEKS, MIN_PATH_TRAIN, MIN_PATH_TEST = 8, 200, 50
LEAK_IC, LEAK_T, RANDOM_SHARPE, NEWS_P = 0.005, 2.5, 0.2, 0.05


def training_rows(panel: DataFrame, decision: date | str) -> DataFrame:
    """Rows whose label was complete before the decision."""
    return panel.filter(F.col(S.LABEL).isNotNull() & (F.col(S.T1) < F.lit(decision).cast("date")))


def score_decision(panel: DataFrame, decision: date | str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The decision's rows with the prediction of a model fitted on all labels that had closed by then."""
    target = panel.filter(F.col(S.DECISION) == F.lit(decision).cast("date"))
    return fit(training_rows(panel, decision))(target)


def save_fitted(spark: SparkSession, fitted: Fitted, path: str, trained_through: date, config: str = "") -> None:
    """The pipeline and a card beside it: features in order, fill values, last training date."""
    fitted.model.write().overwrite().save(f"{path}/model")
    card = [(json.dumps(fitted.columns), json.dumps(fitted.fills), trained_through, config)]
    spark.createDataFrame(card, "features string, fills string, trained_through date, config string").write.mode("overwrite").json(f"{path}/card")


def load_fitted(spark: SparkSession, path: str, features: list[str], decision: date, max_age_weeks: float = MAX_MODEL_AGE_WEEKS) -> Fitted:
    """A saved model for a decision; refused when its features are not exactly those given, or when it is too old."""
    card = spark.read.schema("features string, fills string, trained_through date, config string").json(f"{path}/card").first()
    names = json.loads(card.features)
    if set(names) != set(features):
        raise ValueError(f"features differ: missing {sorted(set(names) - set(features))}, unknown {sorted(set(features) - set(names))}")
    age = (decision - card.trained_through).days / 7.0
    if age > max_age_weeks:
        raise ValueError(f"trained through {card.trained_through}, {age:.0f} weeks before {decision}; the limit is {max_age_weeks}")
    return Fitted(PipelineModel.load(f"{path}/model"), names, json.loads(card.fills))


def block_contribution(df: DataFrame, *, price: str = "price_score", news: str = "news_score", has_news: str = "has_news",
                       price_weight: float = 0.9, news_weight: float = 0.1, by=(S.DECISION,), method: str = "buckets") -> DataFrame:
    """Share of the score's spread that each block gives: weight times deviation of its rank, news times its coverage."""
    masked = df.select(*by, S.TICKER, F.col(price).alias("_p"), F.when(F.col(has_news), F.col(news)).alias("_n"), F.col(has_news).cast("double").alias("_h"))
    ranked = ranks.rank_pct(masked, list(by), ["_p", "_n"], keys=[*by, S.TICKER], method=method, suffix="_r")
    parts = ranked.agg((price_weight * F.coalesce(F.stddev_pop("_p_r"), F.lit(0.0))).alias("_price"), F.coalesce(F.avg("_h"), F.lit(0.0)).alias("news_coverage"),
                       (news_weight * F.coalesce(F.stddev_pop("_n_r"), F.lit(0.0))).alias("_news"))
    news_part = F.col("_news") * F.col("news_coverage")
    total = F.col("_price") + news_part
    share = lambda x, none: F.coalesce(F.when(total > 0, div(x, total)), F.lit(none))
    return parts.select(share(F.col("_price"), 1.0).alias("price"), share(news_part, 0.0).alias("news"), "news_coverage")


def path_scores(panel: DataFrame, folds: DataFrame, candidates: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(path, candidate, in_sample, out_of_sample): mean weekly rank correlation of each candidate on each path.

    Paths and candidates are few; each fit is a distributed job over a table that ``panel`` should be. A path with too few
    labels keeps its rows, with null scores.
    """
    keys = [S.DECISION, S.TICKER]
    known = folds.join(panel.filter(F.col(S.LABEL).isNotNull()).select(*keys), keys).groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
    out = None
    for path, a, b in sorted(known.collect()):  # one row for each path
        rows = lambda role: panel.join(folds.filter((F.col("fold") == path) & (F.col("role") == role)).select(*keys), keys)  # noqa: B023, E731
        for name, fit in candidates.items():
            if a < MIN_PATH_TRAIN or b < MIN_PATH_TEST:
                one = panel.sparkSession.createDataFrame([(None, None)], "in_sample double, out_of_sample double")
            else:
                predict = fit(rows("train"))
                mean = lambda role: skill.periodic_ic(predict(rows(role))).agg(F.avg("ic").alias("v"))  # noqa: B023, E731
                one = mean("train").select(F.col("v").alias("in_sample")).crossJoin(mean("test").select(F.col("v").alias("out_of_sample")))  # one row each
            one = one.select(F.lit(path).alias("path"), F.lit(name).alias("candidate"), "in_sample", "out_of_sample")
            out = one if out is None else out.union(one)
    return out


def path_selections(scores: DataFrame) -> DataFrame:
    """Per path: the candidate that is best in sample, both its scores, and its place out of sample."""
    place = F.rank().over(Window.partitionBy("path").orderBy(F.col("out_of_sample").desc()))  # one row for each candidate
    usable = scores.filter("in_sample is not null and out_of_sample is not null").withColumn("place", place)
    best = F.min_by(F.struct("candidate", "in_sample", "out_of_sample", "place"), F.struct(-F.col("in_sample"), F.col("candidate")))
    return usable.groupBy("path").agg(best.alias("b"), F.count("*").alias("n_candidates")).select(
        "path", F.col("b.candidate").alias("chosen"), "b.in_sample", "b.out_of_sample", F.col("b.place").alias("out_of_sample_place"), "n_candidates")


def cost_sensitivity(ledger: DataFrame, scales: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0), by=("scenario",)) -> DataFrame:
    """Performance of each scenario with its costs multiplied by each scale; predictions and books stay as they are."""
    every = ledger.withColumn("cost_scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    scaled = every.withColumn("cost", F.col("cost") * F.col("cost_scale")).withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return performance.metrics(scaled, (*by, "cost_scale"))


def summary_rows(metrics: DataFrame, interval: DataFrame, ic: DataFrame, by=("scenario",)) -> DataFrame:
    """One row for each scenario: performance, interval of its Sharpe ratio, and rank correlation."""
    keys = list(by)
    both = metrics.join(interval, keys, "left").join(ic.select(*keys, "mean_ic", "t_stat"), keys, "left")
    r = lambda c, n: F.round(F.col(c), n)
    return both.select(*keys, r("sharpe", 3).alias("sharpe"), r("sharpe_ci_low", 2).alias("sharpe_ci_low"), r("sharpe_ci_high", 2).alias("sharpe_ci_high"),
                       r("ann_return", 4).alias("ann_return"), r("ann_vol", 4).alias("ann_vol"), r("max_drawdown", 4).alias("max_dd"), r("calmar", 3).alias("calmar"),
                       r("hit_rate", 3).alias("hit_rate"), r("turnover", 3).alias("turnover"), r("cost_drag_bps", 2).alias("cost_bps"),
                       r("mean_ic", 4).alias("ic"), r("t_stat", 2).alias("ic_t"), F.col("n_periods").alias("n_weeks"))


def verdicts(summary: DataFrame, news_test: DataFrame | None = None, *, primary: str = "price_news") -> DataFrame:
    """(rule, holds, value, against) over the summary rows of the variants; a rule whose variants are absent has null.

    ``summary``: scenario, sharpe, ic, ic_t, one row for each variant. ``news_test``: difference and p_value of the paired test.
    """
    of = lambda name, c: F.max(F.when(F.col("scenario") == name, F.col(c)))
    row = summary.agg(*[of(n, c).alias(f"{n}_{c}") for n in ("shuffled", "momentum", "random", "benchmark", primary) for c in ("sharpe", "ic", "ic_t")])
    if news_test is not None:
        row = row.crossJoin(news_test.select("difference", "p_value").limit(1))  # one row each
    else:
        row = row.withColumns({"difference": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})
    c = F.col
    rules = [("no_leak", ~((c("shuffled_ic") > LEAK_IC) & (c("shuffled_ic_t") > LEAK_T)), c("shuffled_ic"), F.lit(LEAK_IC)),
             ("beats_momentum", c(f"{primary}_sharpe") > c("momentum_sharpe"), c(f"{primary}_sharpe"), c("momentum_sharpe")),
             ("random_is_poor", c("random_sharpe") <= RANDOM_SHARPE, c("random_sharpe"), F.lit(RANDOM_SHARPE)),
             ("news_adds", (c("p_value") < NEWS_P) & (c("difference") > 0), c("difference"), c("p_value")),
             ("beats_benchmark", c(f"{primary}_sharpe") > c("benchmark_sharpe"), c(f"{primary}_sharpe"), c("benchmark_sharpe"))]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), h.alias("holds"), v.cast("double").alias("value"), a.cast("double").alias("against"))
                                          for n, h, v, a in rules])).alias("r")).select("r.*")
