"""Bars from landed files: per-ticker CSV or parquet, candle JSON, chart JSON, vendor CSV."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import canonical_bars

# Header names understood as one of the bar columns.
ALIASES = {
    "date": "session", "datetime": "session", "timestamp": "session", "time": "session", "o": "open", "h": "high", "l": "low",
    "c": "close", "v": "volume", "vol": "volume", "qty": "volume", "shares traded": "volume", "total traded quantity": "volume",
}


def _rename(df: DataFrame) -> DataFrame:
    names = {c: ALIASES.get(c.strip().lower(), c.strip().lower()) for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def _ticker() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)


def _finish(df: DataFrame, start, end, close_hour: int) -> DataFrame:
    if "session" not in df.columns:
        raise ValueError("no recognisable date column")
    present = [c for c in ("open", "high", "low") if c in df.columns]
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low") if c not in present})
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    day = F.expr("try_cast(substring(cast(session as string), 1, 10) as date)")
    df = df.withColumn("session", day).filter(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return canonical_bars(df, close_hour=close_hour)


def read_ticker_files(spark: SparkSession, paths: list[str] | str, *, start="1900-01-01", end="2999-12-31", fmt: str = "csv",
                      close_hour: int = 21, tickers: list[str] | None = None) -> DataFrame:
    """One file per ticker, the ticker being the file name up to its first dot.

    Files in one call share their headers; files with other headers go into another call and the results are unioned.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(paths)
    named = _rename(raw.select("*", _ticker().alias("ticker")))
    if tickers:
        named = named.filter(F.upper("ticker").isin(*[t.upper() for t in tickers]))
    return _finish(named, start, end, close_hour)


def read_vendor_csv(spark: SparkSession, paths: list[str] | str, *, start="1900-01-01", end="2999-12-31", close_hour: int = 21) -> DataFrame:
    """Vendor text files with Date,Open,... headers; a payload that is not such a CSV parses to no usable date."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(
        "date string, open string, high string, low string, close string, volume string").option("enforceSchema", True).csv(paths)
    named = raw.select("*", _ticker().alias("ticker")).withColumnRenamed("date", "session")
    return _finish(named, start, end, close_hour).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def read_candles(spark: SparkSession, paths: list[str] | str, *, zone: str = "Asia/Kolkata", close_hour: int = 10) -> DataFrame:
    """Candle JSON: arrays of [timestamp, open, high, low, close, volume, open interest]; the session is the local date."""
    raw = spark.read.schema("data struct<candles: array<array<string>>>").json(paths)
    c = raw.select(_ticker().alias("ticker"), F.explode("data.candles").alias("x"))
    at = lambda i: F.element_at("x", i)
    day = F.from_utc_timestamp(at(1).try_cast("timestamp"), zone).cast("date")
    names = ("open", "high", "low", "close", "volume")
    return canonical_bars(c.select("ticker", day.alias("session"), *[at(i + 2).alias(n) for i, n in enumerate(names)]), close_hour=close_hour)


_EVENT = "map<string, struct<date: bigint, numerator: double, denominator: double, amount: double>>"
CHART = ("chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<"
         "open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>>,"
         f"events: struct<splits: {_EVENT}, dividends: {_EVENT}>>>>")


def read_charts(spark: SparkSession, paths: list[str] | str, *, close_hour: int = 21) -> DataFrame:
    """Chart JSON: parallel arrays of quotes, with split and dividend events put on their session."""
    r = spark.read.schema(CHART).json(paths).select(_ticker().alias("ticker"), F.element_at("chart.result", 1).alias("r"))
    names = ("open", "high", "low", "close", "volume")
    quote = F.element_at("r.indicators.quote", 1)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("ts"), *[quote[n].alias(n) for n in names])
    bars = r.select("ticker", F.explode(zipped).alias("q")).select("ticker", F.timestamp_seconds("q.ts").cast("date").alias("session"),
                                                                   *[f"q.{n}" for n in names])

    def events(kind, value, name):
        e = r.select("ticker", F.explode(F.map_values(f"r.events.{kind}")).alias("e"))
        return e.groupBy("ticker", F.timestamp_seconds("e.date").cast("date").alias("session")).agg(F.max(value).alias(name))

    ratio = F.coalesce("e.numerator", F.lit(1.0)) / F.coalesce(F.nullif("e.denominator", F.lit(0.0)), F.lit(1.0))
    keys = ["ticker", "session"]
    full = bars.join(events("splits", ratio, "split_factor"), keys, "left").join(
        events("dividends", F.coalesce("e.amount", F.lit(0.0)), "div_cash"), keys, "left")
    return canonical_bars(full, close_hour=close_hour)


def by_precedence(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Whole tickers from the first source that has them, in the order given; with the attribution table."""
    tagged = [df.withColumns({"_rank": F.lit(i), "source": F.lit(name)}) for i, (name, df) in enumerate(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    best = every.groupBy("ticker").agg(F.min("_rank").alias("_rank"))
    chosen = every.join(best, ["ticker", "_rank"]).drop("_rank", "source")
    name = F.element_at(F.array(*[F.lit(n) for n in sources]), F.col("_rank") + 1)
    return chosen, best.select("ticker", name.alias("source"))
