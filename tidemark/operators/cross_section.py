"""Transforms within one date: ranks, z-scores, neutralisation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.functions.exprs import div, finite


def cross_sectional_rank(df: DataFrame, columns: list[str], *, date: str = S.DECISION, min_names: int = 20,
                         method: str = "buckets", row: str | None = None) -> DataFrame:
    """Replace each column by its percentile rank within the date, centred on zero; null on thin dates. ``row`` as in ``rank_pct``."""
    sizes = df.groupBy(F.col(date).alias("_date")).agg(F.count("*").alias("_names"))
    sized = df.join(F.broadcast(sizes), F.col(date).eqNullSafe(F.col("_date"))).drop("_date")  # one row for each date
    ranked = ranks.rank_pct(sized, [date], columns, method=method, row=row)
    enough = F.col("_names") >= min_names
    return ranked.withColumns({c: F.when(enough, F.col(c) - 0.5) for c in columns}).drop("_names").select(*df.columns)


def cross_sectional_zscore(df: DataFrame, columns: list[str], *, date: str = S.DECISION, winsorize: float = 0.02,
                           min_names: int = 20, method: str = "buckets") -> DataFrame:
    """Clip each column to its date's quantiles, then centre and scale; null below ``min_names`` values.

    Quantiles of all columns come from one melted table, mean and deviation from one aggregate; one row per date joins
    back for each.
    """
    if not columns:
        return df
    out = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    same = lambda: F.col(date).eqNullSafe(F.col("_date"))
    if winsorize > 0:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])
        long = out.select(F.col(date).alias("_date"), F.explode(pairs).alias("p")).select("_date", F.col("p.i").alias("_col"), F.col("p.v").alias("_v"))
        q = ranks.quantiles(long, ["_date", "_col"], "_v", [winsorize, 1.0 - winsorize], method=method)
        cuts = q.groupBy("_date").agg(*[F.max(F.when(F.col("_col") == i, F.col("q"))).alias(f"_q{i}") for i in range(len(columns))])
        out = out.join(cuts, same(), "left").withColumns({
            c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_q{i}")[1]), F.col(f"_q{i}")[0])) for i, c in enumerate(columns)})
        out = out.drop("_date", *[f"_q{i}" for i in range(len(columns))])
    stats = out.groupBy(F.col(date).alias("_date")).agg(*[x for i, c in enumerate(columns) for x in (
        F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"), F.count(c).alias(f"_n{i}"))])
    out = out.join(stats, same(), "left").withColumns({
        c: F.when(F.col(f"_n{i}") >= min_names, div(F.col(c) - F.col(f"_m{i}"), f"_s{i}")) for i, c in enumerate(columns)})
    return out.select(*df.columns)


def sector_neutralize(df: DataFrame, columns: list[str], *, date: str = S.DECISION, sector: str = S.SECTOR,
                      min_per_sector: int = 3) -> DataFrame:
    """Subtract the (date, sector) mean where the sector has enough values that day."""
    if sector not in df.columns:
        return df
    means = df.groupBy(F.col(date).alias("_date"), F.col(sector).alias("_sector")).agg(
        *[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.count(c).alias(f"_n_{c}"))])
    same = F.col(date).eqNullSafe(F.col("_date")) & F.col(sector).eqNullSafe(F.col("_sector"))
    centred = {c: F.when(F.col(f"_n_{c}") >= min_per_sector, F.col(c) - F.col(f"_m_{c}")).otherwise(F.col(c)) for c in columns}
    return df.join(means, same, "left").withColumns(centred).select(*df.columns)


def cross_sectional_demean(df: DataFrame, column: str, *, date: str = S.DECISION, output: str | None = None, by=None) -> DataFrame:
    keys = list(by or (date,))
    means = df.groupBy(*keys).agg(F.avg(column).alias("_m"))
    small = F.broadcast(means) if keys == [date] else means  # one row for each date
    return df.join(small, keys, "left").withColumn(output or column, F.col(column) - F.col("_m")).drop("_m")


def drop_thin_dates(df: DataFrame, *, date: str = S.DECISION, min_names: int = 20) -> DataFrame:
    """Keep the dates with enough rows. The dates are few: the list of good ones is sent to the rows."""
    good = df.groupBy(date).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_names).select(date)
    return df.join(F.broadcast(good), date, "left_semi")


