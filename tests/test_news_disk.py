"""The news searches store texts and no n-grams; the grid of cut-offs is sent to the articles."""

import pathlib

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import dedupe, news_features


def _written(monkeypatch, folder, work):
    """Bytes of the tables that ``work`` leaves in the shared folder."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(folder))
    work()
    return sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet"))


def test_tables_of_the_searches_are_no_larger_than_the_texts(spark, tmp_path, monkeypatch):
    word = F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.col("k").cast("string")), 256), 1, 6)
    rows = spark.range(200).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("body"))
    rows = rows.select("id", F.col("id").cast("string").alias("content_hash"), F.lit("A").alias("ticker"), F.lit("").alias("title"), "body",
                       F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("available_at"))
    rows.write.parquet(f"{tmp_path}/given")
    given = spark.read.parquet(f"{tmp_path}/given")
    size = sum(p.stat().st_size for p in (tmp_path / "given").glob("*.parquet"))
    made = _written(monkeypatch, tmp_path / "novelty", lambda: dedupe.novelty_scores(given).count())
    assert made < 2 * size
    made = _written(monkeypatch, tmp_path / "near", lambda: dedupe.deduplicate(given).count())
    assert made < 2 * size


def test_stories_meet_across_blocks(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    rows = [(i, f"h{i}", "A", "", " ".join(words[(i * k) % 40] for k in range(1, 20 + i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, content_hash string, ticker string, title string, body string").withColumn(
        "available_at", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200))
    found = []
    for chars in (dedupe.BLOCK_CHARS, 20_000):
        monkeypatch.setattr(dedupe, "BLOCK_CHARS", chars)
        found.append((sorted(dedupe.novelty_scores(df).collect()), sorted(r.id for r in dedupe.deduplicate(df).collect())))
    assert found[0] == found[1]
    assert 0 < len(found[0][1]) < 60


def test_the_grid_is_sent_to_the_articles(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arts = spark.range(1000).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("available_at"))
        grid = spark.range(9).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("decision_session"))
        grid = grid.withColumn("decision_ts", F.col("decision_session").cast("timestamp") + F.make_interval(hours=F.lit(21)))
        plan = news_features.visible_articles(arts, grid)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
