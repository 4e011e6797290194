"""Universe membership over time."""

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S

# Loss booked when no delisting return is on file; exit share below which a file is a snapshot.
DEFAULT_DELISTING_RETURN = -0.30
SURVIVORSHIP_EXIT_SHARE = 0.05


def members_asof(universe: DataFrame, asof: date | str, max_names: int | None = None) -> DataFrame:
    """Members on a date; only where a universe is defined as its first names in file order, those ``max_names``."""
    day = F.lit(asof).cast("date")
    live = universe.filter(
        (F.col("start_date").isNull() | (F.col("start_date") <= day))
        & (F.col("end_date").isNull() | (F.col("end_date") >= day)))
    out = live.select(S.TICKER, "name", S.SECTOR, "file_order")
    if max_names:
        out = out.orderBy("file_order").limit(max_names)
    return out.drop("file_order")


def membership_panel(universe: DataFrame, sessions_df: DataFrame, max_names: int | None = None) -> DataFrame:
    """Every (session, ticker, sector) that was a member.

    The interval becomes its days, then an equi-join keeps the days that are sessions: the work is the size of the
    answer, with no pairwise comparison of names and sessions.
    """
    span = sessions_df.agg(F.min(S.SESSION).alias("lo"), F.max(S.SESSION).alias("hi"))
    lo = F.greatest(F.coalesce("start_date", "lo"), F.col("lo"))
    hi = F.least(F.coalesce("end_date", "hi"), F.col("hi"))
    days = (
        universe.crossJoin(F.broadcast(span))  # one row
        .withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
        .select(S.TICKER, S.SECTOR, "file_order", F.explode(F.sequence("_lo", "_hi")).alias(S.SESSION))
    )
    panel = days.join(sessions_df.select(S.SESSION), S.SESSION)
    if max_names:
        rank = F.row_number().over(Window.partitionBy(S.SESSION).orderBy("file_order"))
        panel = panel.withColumn("_n", rank).filter(F.col("_n") <= max_names)
    return panel.select(S.SESSION, S.TICKER, S.SECTOR)


def sectors(universe: DataFrame) -> DataFrame:
    return universe.select(S.TICKER, S.SECTOR)


def lot_sizes(universe: DataFrame) -> DataFrame:
    """Declared increments above one; a name that is absent has an unknown lot, not a lot of one."""
    return universe.select(S.TICKER, F.col("lot_size").cast("int").alias("lot_size")).filter("lot_size > 1")


def delisting_returns(universe: DataFrame, default: float = DEFAULT_DELISTING_RETURN) -> DataFrame:
    """Exit session and terminal return of the names that left."""
    return universe.filter(F.col("end_date").isNotNull()).select(
        S.TICKER, F.col("end_date").alias(S.SESSION),
        F.coalesce("delisting_return", F.lit(default)).alias("delisting_return"))


def survivorship_check(universe: DataFrame, name: str = "universe") -> DataFrame:
    """One row: names, exits, whether the file is a present-day snapshot, and the warning."""
    n, exits = F.col("n_names"), F.col("n_exits")
    needed = F.greatest(F.lit(1), F.floor(n * F.lit(SURVIVORSHIP_EXIT_SHARE)).cast("int"))
    history = F.when(exits == 0, "has no delisting history").otherwise(
        F.concat(F.lit("records only "), exits.cast("string"), F.lit(" exit(s) across "), n.cast("string"), F.lit(" names")))
    return (
        universe.agg(F.count("*").alias("n_names"), F.count("end_date").alias("n_exits"))
        .withColumn("is_biased", exits < needed)
        .withColumn("warning", F.when(F.col("is_biased"), F.concat(
            F.lit(f"{name} "), history, F.lit("; results from it are survivorship-biased and optimistic"))))
    )
