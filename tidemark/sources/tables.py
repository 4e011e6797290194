"""Keyed tables, coverage and provenance, instrument and universe files, articles, and sinks."""

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.exprs import col
from tidemark.sources.fixtures import name_files


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append and keep the newer row of each key; an aggregate, so copies meet on the map side."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys and c != "_batch"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("r")).select(*keys, "r.*")


def read_many(spark: SparkSession, pattern: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(pattern)
    return df.select(*columns) if columns else df


def covered_tickers(bars: DataFrame, start, end, slack_days: int = 7) -> DataFrame:
    """Tickers whose stored span reaches both ends of the request, give or take a week."""
    span = bars.groupBy("ticker").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    return span.filter((F.col("lo") <= F.date_add(F.lit(start).cast("date"), slack_days))
                       & (F.col("hi") >= F.date_sub(F.lit(end).cast("date"), slack_days))).select("ticker")


def merge_attribution(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Ticker to original source; a cache is where an answer was kept and never counts as its source."""
    return upsert(existing, new.filter("source <> 'cache'"), ["ticker"])


def provenance_summary(attribution: DataFrame, fabricated=("synthetic", "synthetic-csv")) -> DataFrame:
    made = F.col("source").isin(*fabricated)
    n, bad = F.count("*"), F.count_if(made)
    return attribution.agg(
        n.alias("n_tickers"), bad.alias("n_fabricated"), (n - bad).alias("n_real"),
        F.when(n == 0, "unknown").when(bad == 0, "observed").when(bad == n, "generated").otherwise("mixed").alias("verdict"))


def instrument_snapshot(dump: DataFrame) -> DataFrame:
    """Cash equities with the lot of their nearest-expiry future."""
    fut = dump.filter("segment = 'NSE_FO' and instrument_type = 'FUT' and asset_symbol is not null").groupBy("asset_symbol").agg(
        F.min_by("lot_size", F.coalesce("expiry", F.lit(0))).alias("lot_size"))
    eq = dump.filter("segment = 'NSE_EQ' and instrument_type = 'EQ'").drop("lot_size", "asset_symbol")
    return eq.join(fut, eq.trading_symbol == fut.asset_symbol, "left").select(
        F.col("trading_symbol").alias("ticker"), F.coalesce("name", "trading_symbol").alias("name"),
        F.coalesce("isin", F.lit("")).alias("isin"), F.coalesce("instrument_key", F.lit("")).alias("instrument_key"),
        F.coalesce(F.col("lot_size").cast("int"), F.lit(0)).alias("lot_size"),
        F.coalesce(F.col("freeze_quantity").cast("int"), F.lit(0)).alias("freeze_quantity"))


def universe_table(raw: DataFrame, file_order: Column | str = "file_order") -> DataFrame:
    """Membership columns with defaults; the first row of a ticker wins."""
    lower = raw.select(*[F.col(c).alias(c.strip().lower()) for c in raw.columns])
    has = lambda c, kind: F.expr(f"try_cast({c} as {kind})") if c in lower.columns else F.lit(None).cast(kind)
    out = lower.select(
        F.trim("ticker").alias("ticker"), F.coalesce(has("name", "string"), F.trim("ticker")).alias("name"),
        F.coalesce(F.trim(has("sector", "string")), F.lit("Unknown")).alias("sector"), has("start_date", "date").alias("start_date"),
        has("end_date", "date").alias("end_date"), has("delisting_return", "double").alias("delisting_return"),
        has("lot_size", "double").alias("lot_size"), col(file_order).alias("file_order"))
    values = [c for c in out.columns if c != "ticker"]
    return out.groupBy("ticker").agg(F.min_by(F.struct(*values), "file_order").alias("r")).select("ticker", "r.*")


def _instant(c: str) -> Column:
    """Epoch seconds or ISO text; text without a zone is UTC."""
    number = F.expr(f"try_cast({c} as double)")
    return F.coalesce(F.timestamp_micros((number * 1e6).cast("long")), F.expr(f"try_cast({c} as timestamp)"))


def read_articles(spark: SparkSession, path: str, *, tickers: list[str] | None = None, start="1900-01-01", end="2999-12-31") -> DataFrame:
    """Articles from JSON Lines; malformed lines, undated and empty articles are skipped."""
    names = ("content_hash", "ticker", "title", "body", "description", "url", "source", "published_at", "first_seen_at")
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("mode", "DROPMALFORMED").json(path)
    return parse_articles(raw, tickers=tickers, start=start, end=end)


def parse_articles(raw: DataFrame, *, tickers: list[str] | None = None, start="1900-01-01", end="2999-12-31") -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    body = F.when(blank("body") != "", blank("body")).otherwise(blank("description"))
    out = raw.select("content_hash", blank("ticker").alias("ticker"), blank("title").alias("title"), body.alias("body"),
                     F.coalesce("url", F.lit("")).alias("url"), F.coalesce("source", F.lit("jsonl")).alias("source"),
                     _instant("published_at").alias("published_at"), _instant("first_seen_at").alias("first_seen_at"))
    out = out.filter((F.col("ticker") != "") & ((F.col("title") != "") | (F.col("body") != "")))
    out = out.filter(F.col("published_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if tickers:
        out = out.filter(F.col("ticker").isin(*tickers))
    seen = F.coalesce("first_seen_at", "published_at")
    given = F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash"))
    return out.withColumn("first_seen_at", seen).withColumns({
        "available_at": F.greatest("published_at", "first_seen_at"),
        "content_hash": F.coalesce(given, text.article_hash())})


def read_feed(spark: SparkSession, path: str, ingested_at: str, *, max_items: int | None = None) -> DataFrame:
    """Articles from landed RSS files, one per ticker; all items, or the newest ``max_items`` of each ticker."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(
        "title string, link string, pubDate string, description string, source string").load(path)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "<[^>]+>", " "), "&amp;", "&"))
    source = F.when(plain("source") != "", plain("source")).otherwise("google-news")
    now = F.lit(ingested_at).cast("timestamp")
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z")), now)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("ticker"), plain("title").alias("_title"),
                      plain("description").alias("body"), plain("link").alias("url"), source.alias("source"),
                      stamp.alias("published_at"), now.alias("first_seen_at")).filter("_title <> ''")
    tail = F.concat(F.lit(" - "), F.col("source"))
    title = F.when(F.endswith("_title", tail), F.trim(F.substring("_title", F.lit(1), F.length("_title") - F.length(tail)))).otherwise(F.col("_title"))
    rows = rows.withColumn("title", title).drop("_title")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("published_at").desc(), "url"))
    kept = rows if max_items is None else rows.withColumn("_n", place).filter(F.col("_n") <= max_items).drop("_n")
    return kept.withColumns({"content_hash": text.article_hash(), "available_at": F.greatest("published_at", "first_seen_at")})


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """Appends one CSV file with a header for each ticker, in the folder ``ticker=...`` where Spark reads the ticker from.

    Tasks write the files themselves: for many small files, opening and committing them through Spark's writer takes most of the time. A
    folder that pyarrow cannot open is left to that writer.
    """
    # no name and an empty one share a folder, as with Spark's writer: they must share a file too
    dealt = bars.withColumn("ticker", F.nullif(F.col("ticker").cast("string"), F.lit(""))).repartition("ticker")
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        dealt.write.partitionBy("ticker").option("header", True).mode("append").csv(path)
        return
    names, file = [c for c in bars.columns if c != "ticker"], f"part-{uuid.uuid4().hex}.csv"
    place = lambda ticker: (f"ticker={_escaped(ticker)}", file)
    lines = dealt.sortWithinPartitions("ticker").select("ticker", F.to_csv(F.struct(*names)).alias("line"))
    lines.mapInArrow(name_files(path, "_drafts", place, ",".join(names) + "\n"), "files bigint").agg(F.sum("files")).collect()  # one number


def _escaped(value: str | None) -> str:
    """A partition's folder name as Spark writes and reads it."""
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def write_articles(articles: DataFrame, path: str) -> None:
    articles.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Orders, blotters and weekly frames."""
    df.write.mode("append").option("header", True).csv(path)
