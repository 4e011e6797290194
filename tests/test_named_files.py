"""Files named after a key are written by the tasks."""

import os

from pyspark.sql import functions as F

from tidemark.sources import fixtures as fx


def test_named_files_are_whole_and_written_once(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("N"), (F.col("id") % 7).cast("string")).alias("name"), F.col("id"))
    df = df.union(spark.createDataFrame([(None, 5), ("a b", 6)], "name string, id long"))
    folder = fx.named_files(df, "name", F.col("id").cast("string"), ".us.txt", f"file://{tmp_path}/out", header="head", last="end")
    got = {n: (tmp_path / "out/named" / n).read_text().split("\n") for n in os.listdir(tmp_path / "out/named") if not n.startswith(".")}
    assert folder.endswith("/named")
    assert sorted(got) == sorted([*(f"N{k}.us.txt" for k in range(7)), "a b.us.txt", "__HIVE_DEFAULT_PARTITION__.us.txt"])
    for k in range(7):
        lines = got[f"N{k}.us.txt"]
        assert lines[0] == "head" and lines[-2:] == ["end", ""]
        assert sorted(map(int, lines[1:-2])) == list(range(k, 2000, 7))
    assert not (tmp_path / "out/parts").exists()  # nothing for the driver to rename
