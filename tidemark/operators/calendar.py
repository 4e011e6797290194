"""The trading calendar observed in the data, the weekly decision grid, and weekly bars.

Tables here hold one row per session or per calendar day, whatever the number of names, so their windows may run
unpartitioned. Look-ups from large tables into them are equi-joins.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import Trailing

def _by_session():
    return Window.orderBy(S.SESSION)


def sessions(bars: DataFrame) -> DataFrame:
    """Distinct sessions with their 1-based position."""
    return bars.select(S.SESSION).distinct().withColumn("position", F.row_number().over(_by_session()))


def close_instant(session: Column, close: str = "16:00", zone: str = "America/New_York") -> Column:
    """UTC instant of a session's local close, following daylight saving."""
    hour, _, minute = close.partition(":")
    local = session.cast("timestamp") + F.make_interval(hours=F.lit(int(hour)), mins=F.lit(int(minute or 0)))
    return F.to_utc_timestamp(local, zone)


def close_hour_utc(session: Column, close: str = "16:00", zone: str = "America/New_York") -> Column:
    return F.hour(close_instant(session, close, zone))


def decision_sessions(sessions_df: DataFrame, weekday: int = 4) -> DataFrame:
    """Last session of each ISO week on or before the weekday (Monday is 0)."""
    day = F.col(S.SESSION)
    return (
        sessions_df.filter(F.weekday(day) <= weekday)
        .groupBy(F.extract(F.lit("YEAROFWEEK"), day).alias("iso_year"), F.weekofyear(day).alias("iso_week"))
        .agg(F.max(day).alias(S.DECISION))
        .select(S.DECISION)
    )


def _placed(sessions_df: DataFrame, hold: int) -> DataFrame:
    """Every session with the entry and exit sessions that would follow it."""
    return sessions_df.select(
        S.SESSION,
        F.lead(S.SESSION, 1).over(_by_session()).alias(S.ENTRY),
        F.lead(S.SESSION, 1 + hold).over(_by_session()).alias(S.EXIT),
        F.max(S.SESSION).over(Window.partitionBy()).alias("_end"),
        F.lead(S.SESSION, hold).over(_by_session()).alias("_exit_from_here"),
    )


def all_decisions(sessions_df: DataFrame, *, weekday: int = 4, hold: int = 5, close: str = "16:00",
                  zone: str = "America/New_York") -> DataFrame:
    """Every decision with its close instant; entry and exit are null where the data ends first."""
    placed = _placed(sessions_df, hold).withColumnRenamed(S.SESSION, S.DECISION)
    return decision_sessions(sessions_df, weekday).join(placed, S.DECISION).select(
        S.DECISION, close_instant(F.col(S.DECISION), close, zone).alias(S.DECISION_TS), S.ENTRY, S.EXIT,
        "_end", "_exit_from_here")


def weekly_grid(sessions_df: DataFrame, **kw) -> DataFrame:
    """Decisions whose whole forward window exists."""
    grid = all_decisions(sessions_df, **kw).drop("_end", "_exit_from_here")
    return grid.filter(F.col(S.ENTRY).isNotNull() & F.col(S.EXIT).isNotNull())


def latest_decision(sessions_df: DataFrame, **kw) -> DataFrame:
    """Newest decision that can be entered; an exit beyond the data is the last session."""
    live = all_decisions(sessions_df, **kw).filter(F.col(S.ENTRY).isNotNull())
    live = live.withColumn(S.EXIT, F.coalesce(S.EXIT, "_end"))
    return _newest(live)


def decision_for(sessions_df: DataFrame, asof: date | str, **kw) -> DataFrame:
    """The decision on or before a date; without a next session the decision itself is the entry."""
    past = all_decisions(sessions_df, **kw).filter(F.col(S.DECISION) <= F.lit(asof).cast("date"))
    past = past.withColumn(S.EXIT, F.coalesce(
        F.when(F.col(S.ENTRY).isNull(), F.col("_exit_from_here")).otherwise(F.col(S.EXIT)), F.col("_end")))
    return _newest(past.withColumn(S.ENTRY, F.coalesce(S.ENTRY, S.DECISION)))


def _newest(grid: DataFrame) -> DataFrame:
    fields = F.struct(S.DECISION, S.DECISION_TS, S.ENTRY, S.EXIT)
    return grid.agg(F.max_by(fields, S.DECISION).alias("d")).filter("d is not null").select("d.*")


def day_positions(sessions_df: DataFrame) -> DataFrame:
    """For each calendar day of the span: how many sessions lie on or before it, and strictly before it."""
    span = sessions_df.agg(F.min(S.SESSION).alias("lo"), F.max(S.SESSION).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    known = days.join(sessions_df.select(F.col(S.SESSION).alias("day"), F.lit(1).alias("hit")), "day", "left")
    seen = F.count("hit").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return known.select("day", seen.alias("n_upto"), (seen - F.coalesce("hit", F.lit(0))).alias("n_before"))


def shift_sessions(dates: DataFrame, sessions_df: DataFrame, column: str, offset: int = 1) -> DataFrame:
    """``next_session`` and ``prev_session`` of any date, ``offset`` sessions away; null past either end."""
    span = sessions_df.agg(F.min(S.SESSION).alias("_lo"), F.max(S.SESSION).alias("_hi"), F.count("*").alias("_n"))
    day = F.col(column)
    placed = (
        dates.join(day_positions(sessions_df), day == F.col("day"), "left").crossJoin(F.broadcast(span))  # one row
        .withColumn("_upto", F.coalesce("n_upto", F.when(day < F.col("_lo"), 0).otherwise(F.col("_n"))))
        .withColumn("_before", F.coalesce("n_before", F.when(day <= F.col("_lo"), 0).otherwise(F.col("_n"))))
        .withColumn("_next", (F.col("_upto") + offset).cast("int"))
        .withColumn("_prev", (F.col("_before") - offset + 1).cast("int"))
    )
    at = lambda name, key: sessions_df.select(F.col("position").alias(key), F.col(S.SESSION).alias(name))
    return (
        placed.join(at("next_session", "_next"), "_next", "left").join(at("prev_session", "_prev"), "_prev", "left")
        .select(*dates.columns, "next_session", "prev_session")
    )


def sessions_between(sessions_df: DataFrame, start: date | str, end: date | str) -> DataFrame:
    return sessions_df.filter(F.col(S.SESSION).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def week_ends(sessions_df: DataFrame, decisions: DataFrame | None = None, weekday: int = 4) -> DataFrame:
    """Each session with the first decision on or after it; sessions past the last decision are left out."""
    marks = decisions if decisions is not None else decision_sessions(sessions_df, weekday)
    marks = marks.select(F.col(S.DECISION).alias(S.SESSION), F.lit(True).alias("mark")).distinct()
    both = sessions_df.select(S.SESSION).join(marks, S.SESSION, "full")
    newest_first = Window.orderBy(F.col(S.SESSION).desc()).rowsBetween(Window.unboundedPreceding, 0)
    end = F.last(F.when(F.col("mark"), F.col(S.SESSION)), ignorenulls=True).over(newest_first)
    return both.select(S.SESSION, end.alias("week_end")).filter(F.col("week_end").isNotNull())


def to_weekly(bars: DataFrame, decisions: DataFrame | None = None, weekday: int = 4) -> DataFrame:
    """Weekly bars ending on each decision: the sessions after the previous decision up to this one."""
    at = F.col(S.SESSION)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    return (
        bars.join(week_ends(sessions(bars), decisions, weekday), S.SESSION)
        .groupBy(S.TICKER, "week_end")
        .agg(
            F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", known("close")).alias("close"), F.sum("volume").alias("volume"),
            F.product("split_factor").alias("split_factor"), F.sum("div_cash").alias("div_cash"),
            F.max(S.AVAILABLE_AT).alias(S.AVAILABLE_AT), F.count("*").alias("n_sessions"),
        )
        .withColumnRenamed("week_end", S.SESSION)
    )


def weekly_returns(weekly: DataFrame) -> DataFrame:
    t = Trailing()
    return weekly.withColumn("weekly_log_return", F.ln("close") - t.lag(F.ln("close")))


def simple_weekly_returns(bars: DataFrame, weekday: int = 4) -> DataFrame:
    """Close-to-close return of consecutive weekly bars, a gap week giving null on both sides.

    The previous value is the one of the previous *week of the calendar*, so the lag is checked against it.
    """
    weekly = to_weekly(bars, weekday=weekday)
    weeks = weekly.select(S.SESSION).distinct().withColumn("prev_week", F.lag(S.SESSION).over(_by_session()))
    t = Trailing()
    out = weekly.join(weeks, S.SESSION).select(
        S.TICKER, S.SESSION,
        F.when(t.lag(S.SESSION) == F.col("prev_week"), F.col("close") / F.nullif(t.lag("close"), F.lit(0.0)) - 1.0)
        .alias("weekly_return"))
    return out


def align_panel(df: DataFrame, sessions_df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Complete session-by-ticker grid with gaps left null.

    The grid is the requested result, so its size is inherent; it is generated from the (bounded) session list held
    as one array per ticker row, not by a pairwise join.
    """
    days = sessions_df.agg(F.array_sort(F.collect_set(S.SESSION)).alias("days"))
    grid = tickers.select(S.TICKER).distinct().crossJoin(F.broadcast(days))  # one row, one date per session
    grid = grid.select(S.TICKER, F.explode("days").alias(S.SESSION))
    return grid.join(df, [S.TICKER, S.SESSION], "left")
