"""Bars, articles and reference tables derived from the warehouse-style parquet tables."""

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, close_hour: int = 21) -> DataFrame:
    """Daily bars of each supplier: one calendar week of shipments becomes one business-day session.

    Line items meet by supplier and week, so a supplier with a third of all line items is spread over its weeks. They are put together
    by line first, then by week: order and line are one fixed-width number, and of equal ones the price decides.
    """
    li = table(spark, sf_dir, "lineitem")
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / F.lit(7.0))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    priced = li.select(
        "l_suppkey", week.cast("int").alias("k"), F.when(price.isNotNull(), F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("at"),
        price.alias("price"), F.col("l_quantity").alias("qty"),
    )
    lines = priced.repartition("l_suppkey", "k").groupBy("l_suppkey", "k", "at").agg(
        F.min("price").alias("least"), F.max("price").alias("most"), F.sum("qty").alias("qty"))
    daily = lines.groupBy("l_suppkey", "k").agg(
        F.min_by("least", "at").alias("open"),
        F.max("most").alias("high"),
        F.min("least").alias("low"),
        F.max_by("most", "at").alias("close"),
        F.sum("qty").alias("volume"),
    )
    session = F.date_add(F.lit("2000-01-03").cast("date"), (F.floor(F.col("k") / F.lit(5)) * 7 + F.pmod("k", F.lit(5))).cast("int"))
    split = F.when((F.pmod("k", F.lit(97)) == 50) & (F.pmod("l_suppkey", F.lit(10)) == 3), 2.0).otherwise(1.0)
    dividend = F.when(F.pmod("k", F.lit(13)) == 0, F.col("close") * 0.01).otherwise(0.0)
    return daily.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), session.alias("session"), "open", "high", "low", "close", "volume",
        split.alias("split_factor"), dividend.alias("div_cash"),
        (session.cast("timestamp") + F.make_interval(hours=F.lit(close_hour))).alias("available_at"),
        F.lit(False).alias("is_delisted"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe membership from the supplier table; the nation is the sector, every tenth name has an end date."""
    sup, nat = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    day = lambda base, shift: F.date_add(F.lit(base).cast("date"), shift.cast("int"))
    key = F.col("s_suppkey")
    return sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(
        F.concat(F.lit("S"), key.cast("string")).alias("ticker"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("sector"),
        day("2000-01-03", key % 90).alias("start_date"),
        F.when(key % 10 == 0, day("2000-12-01", key % 60)).alias("end_date"),
        F.when(key % 20 == 0, F.lit(-0.5)).alias("delisting_return"),
        F.when(key % 3 == 0, (key % 7 * 25).cast("double")).alias("lot_size"),
        key.alias("file_order"),
    )


#: event name in the ``events`` table -> (event type, sentiment sign)
EVENT_MAP = {
    "purchase": ("earnings_beat", 1.0),
    "view": ("other", 0.0),
    "signup": ("contract_win", 1.0),
    "error": ("litigation", -1.0),
    "click": ("m_and_a_target", 1.0),
}


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article analyses derived from the event stream."""
    from tidemark.operators.analysis import signed_score

    ev = table(spark, sf_dir, "events")
    kind = F.create_map(*[x for k, (e, _) in EVENT_MAP.items() for x in (F.lit(k), F.lit(e))])
    sign = F.create_map(*[x for k, (_, s) in EVENT_MAP.items() for x in (F.lit(k), F.lit(s))])
    sentiment = sign[F.col("event_type")] * F.least(F.col("value") / 100.0, F.lit(1.0))
    base = ev.select(
        "event_id",
        F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"),
        F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("available_at"),
        kind[F.col("event_type")].alias("event_type"),
        sentiment.alias("sentiment"),
        (F.floor("value").cast("int") % 4).alias("magnitude"),
        (F.col("event_id") % 5 == 0).alias("is_speculative"),
        (F.col("event_type") == "view").alias("is_recap"),
        (F.col("event_id") % 7 != 0).alias("is_company_specific"),
        F.when(sentiment > 0.08, "up").when(sentiment < -0.08, "down").otherwise("neutral").alias("expected_direction"),
        F.least(F.abs(sentiment) * 1.4, F.lit(1.0)).alias("direction_confidence"),
        F.when(F.col("event_id") % 11 == 0, F.col("value")).alias("numeric_surprise_pct"),
        (F.col("event_id") % 10 / 10.0).alias("novelty"),
    )
    return base.withColumn("signed_score", signed_score())


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from the documents: first line is the title, one document every ten minutes, language as ticker."""
    doc = table(spark, sf_dir, "documents")
    cut = F.locate("\n", F.col("text"))
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600)
    from tidemark.functions.text import article_hash

    return doc.select(
        F.col("lang").alias("ticker"),
        F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("title"),
        F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise(F.lit("")).alias("body"),
        F.lit("").alias("url"),
        "source",
        stamp.alias("published_at"),
        stamp.alias("first_seen_at"),
        "doc_id",
    ).withColumn("content_hash", article_hash("title", "body")).withColumn(
        "available_at", F.greatest("published_at", "first_seen_at"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays on which events happened, as a session table."""
    day = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select(day.alias("session")).distinct().filter(F.weekday("session") < 5)


def named_files(df: DataFrame, name: str, line, suffix: str, path: str, header: str | None = None, last: str | None = None) -> str:
    """Lines of text in one file for each value of ``name``, called after it; returns the folder.

    For sources whose files are named after a ticker. Tasks write the files under their names themselves: Spark's writer cannot name
    them, and the driver would have to rename one after the other.
    """
    rows = df.select(name, F.lit(1).alias("_k"), line.alias("value"))
    for k, extra in ((0, header), (2, last)):
        if extra:
            rows = rows.union(df.select(name).distinct().select(name, F.lit(k), F.lit(extra)))
    dealt = rows.repartition(name).sortWithinPartitions(name, "_k").select(F.col(name).cast("string"), "value")
    place = lambda value: ("named", ("__HIVE_DEFAULT_PARTITION__" if value is None else quote(value, safe=" ")) + suffix)
    dealt.mapInArrow(name_files(path, "drafts", place), "files bigint").agg(F.sum("files")).collect()  # one number
    return f"{path}/named"


def name_files(path: str, drafts: str, place: Callable[[str | None], tuple[str, str]], header: str = ""):
    """Writes each run of rows (name, line) with one name to ``place(name)``, folder and file under ``path``. A file is moved there when it
    is whole, so a repeated task replaces it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(f"{root}/{drafts}", recursive=True)
        at, out, draft, files = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                folder, file = place(at)
                store.create_dir(f"{root}/{folder}", recursive=True)
                store.move(draft, f"{root}/{folder}/{file}")

        for batch in batches:
            for value, lines in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
                if out is None or value != at:
                    close()
                    at, draft, files = value, f"{root}/{drafts}/{uuid.uuid4().hex}", files + 1
                    out = store.open_output_stream(draft)
                    out.write(header.encode())
                out.write("".join((text or "") + "\n" for _, text in lines).encode())
        close()
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return run
