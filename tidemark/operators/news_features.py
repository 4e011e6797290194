"""News features of each (decision, ticker): a strict interval join, decayed weights, one aggregate."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import clip, div
from tidemark.functions.exprs import Trailing
from tidemark.session import materialise

# The event types of each exposure family.
EVENT_GROUPS = {
    "earnings": ("earnings_beat", "earnings_miss", "earnings_inline"),
    "guidance": ("guidance_up", "guidance_down"),
    "corporate_action": ("m_and_a_target", "m_and_a_acquirer", "buyback", "dilution"),
    "regulatory": ("regulatory_approval", "regulatory_action", "litigation"),
    "analyst": ("analyst_action", "credit_rating"),
    "operational": ("contract_win", "product_launch", "operational_disruption"),
}
FEATURES = tuple(S.NEWS_PREFIX + n for n in (
    "sentiment_decay", "score_decay", "sentiment_max_abs", "count", "count_z", "novelty_weighted", "dispersion",
    "max_magnitude", "days_since_material", "speculative_frac", "recap_frac", "surprise",
    *[f"evt_{g}" for g in EVENT_GROUPS]))


def visible_articles(analyses: DataFrame, grid: DataFrame, lookback_days: int = 10) -> DataFrame:
    """Articles with the decisions that may use them: on or after cut-off minus look-back, strictly before the cut-off.

    An article is spread to the few cut-off days it can reach and meets the grid in an equi-join on the day; the exact
    instants are compared after that. The grid has one row for each session of a calendar and is sent to the articles: by a
    shuffle on the day, all articles of a day would come to one task.
    """
    cutoffs = grid.select(S.DECISION, S.DECISION_TS, F.col(S.DECISION_TS).cast("date").alias("_day"))
    day = F.col(S.AVAILABLE_AT).cast("date")
    spread = analyses.withColumn("_day", F.explode(F.sequence(day, F.date_add(day, lookback_days))))
    return spread.join(F.broadcast(cutoffs), "_day").filter(
        (F.col(S.AVAILABLE_AT) < F.col(S.DECISION_TS))
        & (F.col(S.AVAILABLE_AT) >= F.col(S.DECISION_TS) - F.make_interval(days=F.lit(lookback_days)))).drop("_day")


def aggregate_news(visible: DataFrame, *, half_life_hours: float = 36.0, peer_weight: float = 0.3,
                   speculative_discount: float = 0.5) -> DataFrame:
    """Decay-weighted tone, counts, shares and event exposures; all of it combines before the shuffle."""
    c = F.col
    age = (F.unix_micros(S.DECISION_TS) - F.unix_micros(S.AVAILABLE_AT)) / F.lit(3.6e9)
    weight = (
        F.pow(F.lit(0.5), age / max(half_life_hours, 1e-6))
        * F.when(c("is_company_specific"), 1.0).otherwise(peer_weight)
        * F.when(c("is_speculative"), speculative_discount).otherwise(1.0) * clip("novelty", 0.05, 1.0)
    )
    decayed = lambda x: F.when(F.sum("_w") <= 1e-9, F.avg(x)).otherwise(div(F.sum(c(x) * c("_w")), F.sum("_w")))
    p = S.NEWS_PREFIX
    return visible.withColumn("_w", weight).groupBy(S.DECISION, S.DECISION_TS, S.TICKER).agg(
        decayed("sentiment").alias(f"{p}sentiment_decay"), decayed("signed_score").alias(f"{p}score_decay"),
        F.max(F.abs("sentiment")).alias(f"{p}sentiment_max_abs"), F.count("*").cast("double").alias(f"{p}count"),
        (F.sum(c("signed_score") * c("novelty")) / F.count("*")).alias(f"{p}novelty_weighted"),
        F.stddev_pop("sentiment").alias(f"{p}dispersion"), F.max("magnitude").cast("double").alias(f"{p}max_magnitude"),
        F.avg(c("is_speculative").cast("double")).alias(f"{p}speculative_frac"),
        F.avg(c("is_recap").cast("double")).alias(f"{p}recap_frac"), F.avg("numeric_surprise_pct").alias(f"{p}surprise"),
        *[F.sum(F.when(c("event_type").isin(*members), c("signed_score")).otherwise(0.0)).alias(f"{p}evt_{g}")
          for g, members in EVENT_GROUPS.items()],
    )


def add_abnormal_count(features: DataFrame, baseline_weeks: int = 26) -> DataFrame:
    """Article count against the ticker's own earlier weeks with news (at least six of them)."""
    t = Trailing(order=S.DECISION)
    n = f"{S.NEWS_PREFIX}count"
    return features.withColumns({"_m": t.mean(n, baseline_weeks, 6, shift=1), "_s": t.std(n, baseline_weeks, 6, shift=1)}
                                ).withColumn(f"{n}_z", div(F.col(n) - F.col("_m"), "_s")).drop("_m", "_s")


def add_days_since_material(features: DataFrame, analyses: DataFrame, cap: float = 180.0) -> DataFrame:
    """Days since the last material, non-recap article before the cut-off, whatever its age.

    A backward as-of lookup without collecting a ticker's history: the material articles shrink to the last one of
    each calendar day (an aggregate), a running maximum over those days carries the last earlier day, and the cut-off
    meets it on the day. Articles of the cut-off day itself are compared by instant.
    """
    at = F.col(S.AVAILABLE_AT)
    material = analyses.filter("magnitude >= 2 and not is_recap").select(S.TICKER, at, at.cast("date").alias("_day"))
    days = material.groupBy(S.TICKER, "_day").agg(F.max(S.AVAILABLE_AT).alias("_last"))
    marks = features.select(S.TICKER, F.col(S.DECISION_TS).cast("date").alias("_day")).distinct()
    w = Window.partitionBy(S.TICKER).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.join(marks.withColumn("_mark", F.lit(True)), [S.TICKER, "_day"], "full").withColumn(
        "_before", F.max("_last").over(w)).filter("_mark").select(S.TICKER, "_day", "_before")
    keyed = features.withColumn("_day", F.col(S.DECISION_TS).cast("date"))
    today = keyed.select(S.TICKER, "_day", S.DECISION_TS).distinct().join(material, [S.TICKER, "_day"]).filter(
        at < F.col(S.DECISION_TS)).groupBy(S.TICKER, S.DECISION_TS).agg(F.max(S.AVAILABLE_AT).alias("_today"))
    out = keyed.join(before, [S.TICKER, "_day"], "left").join(today, [S.TICKER, S.DECISION_TS], "left")
    last = F.greatest("_before", "_today")
    age = (F.unix_micros(S.DECISION_TS) - F.unix_micros(last)) / F.lit(86400e6)
    return out.withColumn(f"{S.NEWS_PREFIX}days_since_material", clip(age, high=cap)).drop("_day", "_before", "_today")


def build_news_features(analyses: DataFrame, grid: DataFrame, *, lookback_days: int = 10, baseline_weeks: int = 26,
                        **weights) -> DataFrame:
    # read four times below
    out = materialise(aggregate_news(visible_articles(analyses, grid, lookback_days), **weights), "news")
    out = add_days_since_material(add_abnormal_count(out, baseline_weeks), analyses)
    return out.select(S.DECISION, S.TICKER, *FEATURES)


def coverage_report(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Share of panel rows with news, ticker-weeks with news, median article count."""
    keys = [S.DECISION, S.TICKER]
    hit = panel.select(*keys).join(features.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left").agg(
        F.round(F.coalesce(F.count("_hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("coverage"))
    own = features.agg(F.count_distinct(*keys).alias("n_ticker_weeks"),
                       F.coalesce(F.median(f"{S.NEWS_PREFIX}count"), F.lit(0.0)).alias("median_articles"))
    return hit.crossJoin(own)  # one row each
