"""Expected returns of scores: isotonic regression at any number of points, for all folds in one pass.

The fit is the greatest convex minorant of running sums, so it may be made in pieces: points are pooled inside ordered partitions,
then neighbouring partitions are joined, two by two, only while a block still lies above the first block of the next partition.
"""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.functions.exprs import finite
from tidemark.functions.interpolate import interpolate
from tidemark.session import materialise

# Observations and distinct scores a calibration needs.
MIN_CALIBRATION, MIN_SCORES = 400, 10

_BLOCK = "_group bigint, low double, high double, total double, weight double"


class _Pool:
    """Adjacent violators of one group, pooled as points arrive in order."""

    def __init__(self):
        self.blocks: list[list[float]] = []

    def add(self, low: float, high: float, total: float, weight: float) -> None:
        kept = self.blocks
        while kept and kept[-1][2] / kept[-1][3] >= total / weight:
            last = kept.pop()
            low, total, weight = last[0], last[2] + total, last[3] + weight
        kept.append([low, high, total, weight])


def _pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows (_group, low, high, total, weight); a partition holds whole stretches of one or more groups."""
    current, pool = None, _Pool()
    for batch in batches:
        for group, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != current:
                yield from _emit(current, pool.blocks)
                current, pool = group, _Pool()
            pool.add(*block)
    yield from _emit(current, pool.blocks)


def _emit(group: int | None, blocks: list[list[float]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(blocks), 100_000):
        part = blocks[at:at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(part), pa.int64()), *(pa.array([b[k] for b in part], pa.float64()) for k in range(4))],
                                         names=["_group", "low", "high", "total", "weight"])


def isotonic_blocks(points: DataFrame, group: str, x: str, total: str, weight: str) -> DataFrame:
    """(group, low, high, value, weight): the steps of the isotonic fit of each group, ``low`` and ``high`` its outermost points.

    ``points`` has one row for each group (a whole number) and value of ``x``, with the sum and the number (or weight) of what was
    observed there. Rows are dealt by ranges of (group, x), so no group is one task.
    """
    rows = points.select(F.col(group).cast("bigint").alias("_group"), F.col(x).cast("double").alias("low"), F.col(x).cast("double").alias("high"),
                         F.col(total).cast("double").alias("total"), F.col(weight).cast("double").alias("weight"))
    pooled = rows.repartitionByRange("_group", "low").sortWithinPartitions("_group", "low").mapInArrow(_pool, _BLOCK)
    blocks = materialise(pooled.withColumn("_part", F.spark_partition_id()), "isotonic")
    while True:
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("_group", "_part").agg(F.min_by(mean, "low").alias("_first"), F.max_by(mean, "low").alias("_last"))
        before = F.lag("_last").over(Window.partitionBy("_group").orderBy("_part"))  # one row for each partition
        if not ends.withColumn("_before", before).where("_before >= _first").limit(1).count():
            break
        halves = blocks.withColumn("_part", F.floor(F.col("_part") / 2).cast("int"))
        blocks = materialise(halves.groupBy("_group", "_part").applyInArrow(_join_parts, _BLOCK + ", _part int"), "isotonic")
    return blocks.select(F.col("_group").alias(group), "low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def _join_parts(table: pa.Table) -> pa.Table:
    """The blocks of two neighbouring partitions of a group, pooled again."""
    part = table["_part"][0]
    ordered = table.sort_by("low").select(["_group", "low", "high", "total", "weight"])
    made = pa.Table.from_batches(_pool(ordered.to_batches()))
    return made.append_column("_part", pa.array([part.as_py()] * made.num_rows, pa.int32()))


def calibrate(predictions: DataFrame, *, min_rows: int = MIN_CALIBRATION, min_scores: int = MIN_SCORES) -> DataFrame:
    """``expected_return`` of each score: fold k through an isotonic fit on the folds before it, null where none fits.

    Scores between two fitted ones are read off the line between them, scores beyond them take the outermost value. Scores are added up
    by fold first; what is repeated for the later folds are these sums.
    """
    score, label = finite(F.col(S.PREDICTION).cast("double")), finite(F.col(S.LABEL).cast("double"))
    folds = sorted(r.fold for r in predictions.select("fold").distinct().collect() if r.fold is not None)  # one row per fold
    seen = predictions.select("fold", score.alias("_score"), label.alias("_y")).where("_score is not null and _y is not null")
    sums = seen.groupBy("fold", "_score").agg(F.sum("_y").alias("_total"), F.count("*").alias("_n"))
    later = F.filter(F.array(*[F.lit(k) for k in folds]) if folds else F.array().cast("array<bigint>"), lambda k: k > F.col("fold"))
    points = materialise(sums.select(F.explode(later.cast("array<bigint>")).alias("_k"), "_score", "_total", "_n").groupBy("_k", "_score").agg(
        F.sum("_total").alias("_total"), F.sum("_n").alias("_n")), "points")
    usable = points.groupBy("_k").agg(F.sum("_n").alias("a"), F.count("*").alias("b")).where((F.col("a") >= min_rows) & (F.col("b") >= min_scores)).select("_k")
    blocks = isotonic_blocks(points.join(usable, "_k"), "_k", "_score", "_total", "_n")
    nodes = blocks.select("_k", F.explode(F.array_distinct(F.array("low", "high"))).alias("_score"), F.col("value").alias("expected_return"))
    asked = predictions.select(F.col("fold").cast("bigint").alias("_k"), score.alias("_score")).where("_score is not null").distinct()
    values = interpolate(asked, nodes, ["_k"], "_score", "expected_return")
    rows = predictions.drop("expected_return").withColumns({"_k": F.col("fold").cast("bigint"), "_score": score})
    return rows.join(values, ["_k", "_score"], "left").drop("_k", "_score")


def calibration_table(predictions: DataFrame, n_buckets: int = 10) -> DataFrame:
    """Predicted against realised return by quantile bucket of the prediction.

    With fewer than ten rows for each bucket there is one row instead, without a bucket and with the number of rows found.
    """
    rows = predictions.filter(F.col("expected_return").isNotNull() & F.col(S.LABEL).isNotNull()).withColumn("_all", F.lit(0))
    edges = ranks.quantiles(rows, ["_all"], "expected_return", [i / n_buckets for i in range(n_buckets + 1)])
    enough = F.col("n") >= n_buckets * 10
    placed = rows.join(F.broadcast(edges.filter(enough)), "_all")  # one row
    table = placed.groupBy(ranks.interval_of("expected_return", "q").alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("expected_return").alias("predicted"), F.avg(S.LABEL).alias("realised")).withColumn(
            "error", F.col("predicted") - F.col("realised"))
    none = F.lit(None).cast("double")
    few = rows.agg(F.count("*").alias("n")).filter(~enough)
    return table.unionByName(few.select(F.lit(None).cast("int").alias("bucket"), "n", none.alias("predicted"), none.alias("realised"), none.alias("error")))
