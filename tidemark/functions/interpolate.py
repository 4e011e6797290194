"""Piecewise linear functions given as tables of nodes, read at any number of points."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import order_bucket


def interpolate(points: DataFrame, nodes: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, x, y) at the distinct ``x`` of ``points``: linear between the nodes of the group, level beyond the outermost ones.

    Nodes of a group have distinct ``x``. Points and nodes meet in ordered cells of values; what a cell needs to know of the others are
    their outermost nodes, one row for each cell. Groups without nodes give nulls.
    """
    asked = points.select(*by, x, F.lit(None).cast("double").alias(y))
    both = nodes.select(*by, x, F.col(y).cast("double").alias(y)).union(asked).groupBy(*by, x).agg(F.max(y).alias(y), F.max(F.isnull(y)).alias("_asked"))
    both = both.withColumn("_cell", order_bucket(F.col(x)))
    node = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    up, down = (Window.partitionBy(*by, "_cell").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(x), F.desc(x)))
    inside = both.withColumns({"_low": F.last(node, ignorenulls=True).over(up), "_high": F.last(node, ignorenulls=True).over(down)})
    cells = both.groupBy(*by, "_cell").agg(F.min(node).alias("_first"), F.max(node).alias("_last"))
    before, after = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_cell"), F.desc("_cell")))
    cells = cells.select(*by, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_under"), F.last("_first", ignorenulls=True).over(after).alias("_over"))
    placed = inside.join(cells, [*by, "_cell"]).select(*by, x, "_asked", F.coalesce("_low", "_under").alias("a"), F.coalesce("_high", "_over").alias("b"))
    a, b = F.col("a"), F.col("b")
    between = a["y"] + (F.col(x) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)) * (b["y"] - a["y"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(F.coalesce(between, a["y"]))
    return placed.where("_asked").select(*by, x, value.alias(y))
