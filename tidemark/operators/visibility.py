"""What could be known when: visibility slices and point-in-time checks."""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S


class LookAheadError(AssertionError):
    """A row was visible before it could be known."""


def _instant(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def visible_bars(df: DataFrame, asof: datetime | str | Column) -> DataFrame:
    """Rows available at or before the instant."""
    return df.filter(F.col(S.AVAILABLE_AT) <= _instant(asof))


def visible_news(df: DataFrame, asof: datetime | str | Column) -> DataFrame:
    """Rows available strictly before the instant: an article stamped at the close could not be read in time."""
    return df.filter(F.col(S.AVAILABLE_AT) < _instant(asof))


def truncate_sessions(df: DataFrame, last: date | str, column: str = S.SESSION) -> DataFrame:
    """Rows up to a session; reaches the scan, so later partitions are not read."""
    return df.filter(F.col(column) <= F.lit(last).cast("date"))


def pit_report(frames: dict[str, DataFrame], asof: datetime | str, *, strict: bool = False,
               column: str = S.AVAILABLE_AT) -> DataFrame:
    """Per frame: how many rows are later than the instant, and the latest of them."""
    at = _instant(asof)
    out = None
    for name, df in frames.items():
        late = (F.col(column) >= at) if strict else (F.col(column) > at)
        one = df.agg(F.count_if(late).alias("n_late"), F.max(F.when(late, F.col(column))).alias("worst"))
        one = one.select(F.lit(name).alias("frame"), "n_late", "worst")
        out = one if out is None else out.unionByName(one)
    return out


def assert_pit(frames: dict[str, DataFrame] | DataFrame, asof: datetime | str, *, strict: bool = False) -> None:
    """Raise when any frame holds a row later than the instant."""
    frames = frames if isinstance(frames, dict) else {"frame": frames}
    bad = [r for r in pit_report(frames, asof, strict=strict).collect() if r.n_late]  # one row per frame
    if bad:
        raise LookAheadError("; ".join(f"{r.frame}: {r.n_late} row(s) later than {asof}, worst {r.worst}" for r in bad))


def guard_output(df: DataFrame, last: date | str, column: str = S.SESSION) -> DataFrame:
    """The same rows, failing at run time on any later session; costs no extra pass."""
    late = F.col(column) > F.lit(last).cast("date")
    checked = F.when(late, F.raise_error(F.concat(F.lit("row after the cut-off: "), F.col(column).cast("string")))
                     .cast("date")).otherwise(F.col(column))
    return df.withColumn(column, checked)


def ensure_utc(df: DataFrame, column: str, zone: str | None = None) -> DataFrame:
    """Reject a zone-less timestamp unless its zone is stated, in which case it becomes an instant."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return df
    if isinstance(kind, T.TimestampNTZType) and zone:
        return df.withColumn(column, F.to_utc_timestamp(F.col(column).cast("timestamp"), zone))
    raise ValueError(f"{column} carries no time zone; say which one it is in")
