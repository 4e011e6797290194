"""Incremental ingest with Structured Streaming: articles, bars, and ticks to daily bars."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise
from tidemark.sources.tables import parse_articles, upsert

ARTICLE_JSON = ("content_hash string, ticker string, title string, body string, description string, url string, source string, "
                "published_at string, first_seen_at string")


def article_stream(spark: SparkSession, path: str, *, late: str = "3 days") -> DataFrame:
    """New article files; an exact repeat of a ticker's text inside the watermark is dropped."""
    raw = spark.readStream.schema(ARTICLE_JSON).json(path)
    return parse_articles(raw).withWatermark("available_at", late).dropDuplicatesWithinWatermark(["content_hash", "ticker"])


def upsert_bars(spark: SparkSession, target: str, keys=("ticker", "session"), keep: int = 2):
    """``foreachBatch`` function keeping the last bar of each key, in a table partitioned by the session's year.

    A batch reads and rewrites only the years it touches, all of them in one write. Then it adds a manifest that names the live folder of
    every year; a reader follows one manifest and so sees one state of the whole table. A batch that dies before its manifest leaves
    folders that no manifest names; a batch replayed after it finds the number of its batch in the newest manifest and does nothing.
    The folders of the last ``keep`` manifests stay for readers that are under way, older ones are removed, so storage is bounded.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        version, state = _newest(spark, target)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        stamp = f"{query}:{batch_id}"
        if state and stamp in state["done"]:
            return
        new = materialise(batch.withColumn("_year", F.year(keys[-1])), "batch")  # read for its years and for the merge
        years = sorted(r[0] for r in new.select("_year").distinct().collect() if r[0] is not None)  # as many as years
        live = dict(state["live"]) if state else {}
        before = [f"{target}/{live[str(y)]}" for y in years if str(y) in live]
        bare = new.drop("_year")
        old = spark.read.schema(bare.schema).parquet(*before) if before else bare.limit(0)
        made = f"v={version + 1:012d}-{batch_id}-{uuid.uuid4().hex[:8]}"
        merged = upsert(old, bare.where(F.col(keys[-1]).isNotNull()), list(keys)).withColumn("year", F.year(keys[-1]))
        spread = F.pmod(F.xxhash64(*keys), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # adaptive execution joins small parts
        merged.repartition("year", spread).write.partitionBy("year").parquet(f"{target}/{made}")
        live |= {str(y): f"{made}/year={y}" for y in years}
        done = [*(state["done"] if state else []), stamp][-100:]
        _commit(spark, target, version + 1, {"live": live, "done": done})
        _sweep(spark, target, keep)

    return run


def read_bars(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The table as the newest manifest names it, or as an earlier one did that is still kept."""
    _, state = _newest(spark, target) if version is None else (version, _read(spark, f"{target}/{_MANIFESTS}/{version:012d}"))
    if state is None:
        raise ValueError(f"no table at {target}")
    return spark.read.parquet(*(f"{target}/{folder}" for folder in state["live"].values()))


_MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    root, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one line


def _newest(spark: SparkSession, target: str) -> tuple[int, dict | None]:
    versions = [n for n in _names(spark, f"{target}/{_MANIFESTS}") if n.isdigit()]
    return (int(versions[-1]), _read(spark, f"{target}/{_MANIFESTS}/{versions[-1]}")) if versions else (0, None)


def _commit(spark: SparkSession, target: str, version: int, state: dict) -> None:
    """Write the manifest under another name and rename it: it is there whole or not at all."""
    root, fs = _fs(spark, f"{target}/{_MANIFESTS}/{version:012d}")
    fs.mkdirs(root.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{_MANIFESTS}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if not fs.rename(draft, root):
        raise RuntimeError(f"another writer committed version {version} of {target}")


def _sweep(spark: SparkSession, target: str, keep: int) -> None:
    """Remove manifests before the last ``keep``, and folders that none of the kept ones names."""
    versions = [n for n in _names(spark, f"{target}/{_MANIFESTS}") if n.isdigit()]
    used = {folder for n in versions[-keep:] for folder in _read(spark, f"{target}/{_MANIFESTS}/{n}")["live"].values()}
    for n in versions[:-keep]:
        path, fs = _fs(spark, f"{target}/{_MANIFESTS}/{n}")
        fs.delete(path, False)
    for folder in (n for n in _names(spark, target) if n.startswith("v=")):
        years = [y for y in _names(spark, f"{target}/{folder}") if y.startswith("year=")]
        dead = [y for y in years if f"{folder}/{y}" not in used]
        for y in ([None] if len(dead) == len(years) else dead):
            path, fs = _fs(spark, f"{target}/{folder}" + (f"/{y}" if y else ""))
            fs.delete(path, True)


def ticks_to_bars(ticks: DataFrame, *, at: str = "ts", ticker: str = "ticker", price: str = "value", late: str = "1 day") -> DataFrame:
    """Daily bars of a tick stream (or table): first, highest, lowest, last price and tick count per ticker and day."""
    stream = ticks.withWatermark(at, late) if ticks.isStreaming else ticks
    order = F.struct(F.col(at), F.col(price))
    return stream.groupBy(F.window(at, "1 day").alias("w"), F.col(ticker).alias("ticker")).agg(
        F.min(order)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(order)[price].alias("close"),
        F.count("*").cast("double").alias("volume")).select("ticker", F.col("w.start").cast("date").alias("session"),
                                                            "open", "high", "low", "close", "volume")
