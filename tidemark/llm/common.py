"""What the operators share: session settings, row keys, salted running sums and connected components."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialise, prepare

#: Rows and bytes that one Arrow batch may hold, so that very long texts do not pile up in a worker process.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def session(spark: SparkSession) -> SparkSession:
    """The settings the operators rely on: UTC and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the short way; there ``lower`` means the same."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(columns as lists) -> dict of lists`` over each Arrow batch, as rows of ``schema``."""
    from pyspark.sql.types import StructType

    session(df.sparkSession)
    arrow = pa.schema(_arrow_fields(StructType.fromDDL(schema)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_fields(struct) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in struct]


def salted_running_sum(df: DataFrame, key: str, units: Column, order: list[Column], salt: Column, name: str) -> DataFrame:
    """Adds ``name``: the units of the rows of the same ``key`` that stand before a row, ordered by ``salt`` and then ``order``.

    A key that holds a third of all rows is split: sums run within (key, salt), and the sums of whole salts (one row for each
    key and salt) are added afterwards. ``salt`` must be coarser than ``order`` and spread rows evenly.
    """
    spread = df.withColumns({"__salt": salt, "__units": units})
    within = Window.partitionBy(key, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy(key, "__salt").agg(F.sum("__units").alias("__all"))
               .select(F.col(key).alias("__key"), F.col("__salt").alias("__part"), F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__offset")))
    rows = spread.withColumn("__within", F.coalesce(F.sum("__units").over(within), F.lit(0)))
    joined = rows.join(offsets, rows[key].eqNullSafe(offsets["__key"]) & (rows["__salt"] == offsets["__part"]))
    return joined.withColumn(name, (F.col("__within") + F.col("__offset")).cast("bigint")).drop("__salt", "__units", "__key", "__part", "__offset", "__within", "__all")


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by stars around the smallest node of each local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[x] for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root being the smallest node reachable.

    Edges are first contracted within their partitions, then large-star and small-star steps alternate until nothing moves. The
    rounds grow with the logarithm of the longest chain. Each round is written to the shared folder. Nodes without edges have no row.
    A node with very many edges is no single group: large stars are made by a minimum (combined before the shuffle) and a join that
    adaptive execution may split.
    """
    session(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = materialise(edges.mapInArrow(_stars, "a bigint, b bigint"), name)
    state = None
    while True:
        # large star: each larger neighbour of a node is tied to the smallest node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that both sides of the join come from a plain exchange and the edges of a hub may be split
        least = materialise(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), name)
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node and its smaller neighbours are tied to the smallest of them
        large = materialise(large, name)
        lower = materialise(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), name)
        small = (large.join(lower, large["a"] == lower["n"]).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(lower.select(F.col("n").alias("a"), F.col("m").alias("b"))))
        edges = materialise(small.where("a <> b").distinct(), name)
        # settled when every node has one edge and no root has one: then these are stars
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (now.n, now.h):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state = (now.n, now.h)
