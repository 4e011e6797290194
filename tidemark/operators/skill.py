"""Signal quality: rank correlation per date, its summary, quantile returns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.functions.distributions import t_two_sided_col
from tidemark.functions.exprs import div


def periodic_ic(df: DataFrame, *, prediction: str = S.PREDICTION, label: str = S.LABEL, by=(S.DECISION,), min_names: int = 10,
                min_distinct: int = 2, method: str = "buckets") -> DataFrame:
    """Spearman correlation of prediction and label within each group; thin or constant groups drop out."""
    keys = list(by)
    pairs = df.filter(F.col(prediction).isNotNull() & F.col(label).isNotNull()).select(
        *keys, S.TICKER, F.col(prediction).alias("_p"), F.col(label).alias("_l"))
    ranked = ranks.rank_pct(pairs, keys, ["_p", "_l"], keys=[*keys, S.TICKER], method=method, suffix="_r")
    # ``corr`` would raise for a constant group; two distinct values are seen from least and largest; only more need counting
    rank_corr = div(F.covar_pop("_p_r", "_l_r"), F.stddev_pop("_p_r") * F.stddev_pop("_l_r"))  # what rounding leaves of 0 is 0
    distinct = F.count_distinct("_p") if min_distinct > 2 else F.lit(min_distinct)
    return ranked.groupBy(*keys).agg(
        F.when(F.abs(rank_corr) > 1e-12, rank_corr).otherwise(0.0).alias("ic"), F.count("*").alias("n"), F.min("_p").alias("_p0"), F.max("_p").alias("_p1"),
        F.min("_l").alias("_l0"), F.max("_l").alias("_l1"), distinct.alias("_d")).filter(
            (F.col("n") >= min_names) & (F.col("_p0") < F.col("_p1")) & (F.col("_l0") < F.col("_l1")) & (F.col("_d") >= min_distinct)).select(*keys, "ic", "n")


def ic_statistics(ic: DataFrame, by=()) -> DataFrame:
    """Mean, spread, information ratio, t and hit rate with the date (or whatever a row of ``ic`` is) as observation."""
    out = ic.groupBy(*by).agg(
        F.count("*").alias("n_periods"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    usable = F.col("ic_std") > 1e-12
    return out.withColumns({
        "ic_ir": F.when(usable, div("mean_ic", "ic_std")).otherwise(0.0),
        "t_stat": F.when(usable & (F.col("n_periods") > 2), div("mean_ic", F.col("ic_std") / F.sqrt("n_periods"))).otherwise(0.0)})


def with_p_value(stats: DataFrame) -> DataFrame:
    """Two-sided p-value of each summary row."""
    tested = (F.col("n_periods") > 2) & (F.col("t_stat") != 0.0)
    return stats.withColumn("p_value", F.when(tested, t_two_sided_col("t_stat", F.greatest(F.col("n_periods") - 1, F.lit(1)))).otherwise(1.0))


def ic_verdict(stats: DataFrame) -> DataFrame:
    size = F.abs("mean_ic")
    return stats.withColumn("verdict", F.when(F.col("n_periods") < 52, "too few weeks").when(F.col("p_value") > 0.10, "noise").when(
        size < 0.01, "detectable but tiny").when(size < 0.03, "plausible").otherwise("unusually strong"))


def quantile_returns(df: DataFrame, *, n: int = 10, prediction: str = S.PREDICTION, label: str = S.LABEL, date: str = S.DECISION,
                     method: str = "buckets") -> DataFrame:
    """Mean label per prediction bucket and date, then over dates. Edges are interpolated quantiles of the date."""
    pairs = df.filter(F.col(prediction).isNotNull() & F.col(label).isNotNull()).select(
        date, F.col(prediction).alias("_p"), F.col(label).alias("_l"))
    edges = ranks.quantiles(pairs, [date], "_p", [i / n for i in range(n + 1)], method=method).filter(F.col("n") >= n)
    placed = pairs.join(edges, date).withColumn("bucket", ranks.interval_of("_p", "q")).filter("bucket is not null")
    return placed.groupBy(date, "bucket").agg(F.avg("_l").alias("_m")).groupBy("bucket").agg(F.avg("_m").alias("mean_label"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Spread between the ends and rank correlation of bucket number and mean; one row per bucket comes in."""
    every = Window.partitionBy()
    ranked = buckets.withColumn("_r", ranks.average_rank("mean_label", [F.lit(0)])).withColumn("_n", F.count("*").over(every))
    return ranked.agg(
        (F.max_by("mean_label", "bucket") - F.min_by("mean_label", "bucket")).alias("spread"),
        F.when(F.max("_n") >= 3, F.coalesce(F.corr("bucket", "_r"), F.lit(0.0))).otherwise(0.0).alias("monotonicity"))


def fold_clustered_ic(df: DataFrame, **kw) -> DataFrame:
    """Summary with the fold as observation: a model is fixed within its fold, so the fold's weeks are one draw."""
    weekly = periodic_ic(df, by=("fold", S.DECISION), **kw)
    out = ic_statistics(weekly.groupBy("fold").agg(F.avg("ic").alias("ic")))
    usable = (F.col("ic_std") > 1e-12) & (F.col("n_periods") > 1)
    return out.withColumn("t_stat", F.when(usable, div("mean_ic", F.col("ic_std") / F.sqrt("n_periods"))).otherwise(0.0))


def ic_by_group(df: DataFrame, group: str, **kw) -> DataFrame:
    return ic_statistics(periodic_ic(df, by=(group, S.DECISION), **kw), (group,))


def rolling_ic(ic: DataFrame, *, weeks: int = 26, at_least: int = 10, by=()) -> DataFrame:
    """Mean of the last ``weeks`` rank correlations; a row of ``ic`` is a week, so the series is short."""
    w = Window.partitionBy(*by).orderBy(S.DECISION).rowsBetween(-(weeks - 1), 0)
    return ic.withColumn("rolling_ic", F.when(F.count("ic").over(w) >= at_least, F.avg("ic").over(w)))
