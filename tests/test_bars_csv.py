"""Bars by ticker as CSV: the folders Spark would write, by the tasks themselves."""

import os

from pyspark.sql import functions as F

from tidemark.sources import tables


def test_appended_files_are_read_back_whole(spark, tmp_path):
    names = ["A", "b c", "x/y=z", "50%", "\u00e9\u4e2d", "q'[1]", ""]
    df = spark.createDataFrame([(n, f"2000-01-{d:02d}", d / 3, None if d % 2 else 'a "b", c') for n in names for d in range(1, 9)], "ticker string, session string, open double, note string")
    df = df.withColumn("session", F.col("session").cast("date")).union(spark.createDataFrame([(None, None, 1e-300, "n")], "ticker string, session date, open double, note string"))
    for path in (f"{tmp_path}/out", f"file://{tmp_path}/uri"):
        tables.write_bars_csv(df.where("open > 1"), path)
        tables.write_bars_csv(df.where("open <= 1"), path)
        back = spark.read.option("header", True).schema("session date, open double, note string, ticker string").csv(path).select(df.columns)
        want = df.withColumn("ticker", F.when(F.col("ticker") != "", F.col("ticker")))  # as in Spark's folders
        assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))
    df.repartition("ticker").write.partitionBy("ticker").option("header", True).csv(f"{tmp_path}/spark")
    folders = lambda p: sorted(f for f in os.listdir(p) if "=" in f)
    assert folders(f"{tmp_path}/spark") == folders(f"{tmp_path}/out")
    files = [f for f in os.listdir(f"{tmp_path}/out/ticker=A") if f.endswith(".csv")]
    assert len(files) == 2 and not any(f.startswith(".part") for f in os.listdir(f"{tmp_path}/out/ticker=A"))  # no committer, no checksums
