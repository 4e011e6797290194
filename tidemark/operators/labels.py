"""Forward labels and sample weights."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import Trailing, div, ln_pos
from tidemark.operators.cross_section import cross_sectional_demean


def _open_pairs(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Entry and exit open of each name at each decision.

    Each bar can be the entry or the exit of few decisions, so a bar is tagged with those (one join on the small grid)
    and one aggregate per (decision, ticker) brings the pair together; the bars are never joined with themselves.
    """
    legs = grid.select(S.DECISION, S.ENTRY, S.EXIT, F.explode(F.array(
        F.struct(F.col(S.ENTRY).alias(S.SESSION), F.lit("in").alias("leg")),
        F.struct(F.col(S.EXIT).alias(S.SESSION), F.lit("out").alias("leg")))).alias("x"))
    legs = legs.select(S.DECISION, S.ENTRY, S.EXIT, "x.*")
    tagged = bars.select(S.TICKER, S.SESSION, "open").join(F.broadcast(legs), S.SESSION)  # two rows for each decision
    return tagged.groupBy(S.DECISION, S.TICKER, S.ENTRY, S.EXIT).agg(
        F.max(F.when(F.col("leg") == "in", F.col("open"))).alias("open_in"),
        F.max(F.when(F.col("leg") == "out", F.col("open"))).alias("open_out"))


def build_labels(bars: DataFrame, grid: DataFrame, *, vol_scale: bool = False, vol_window: int = 65) -> DataFrame:
    """Forward log return of each (decision, ticker) less the mean of all names with a valid pair that date."""
    pairs = _open_pairs(bars, grid).filter("open_in > 0 and open_out > 0")
    raw = pairs.withColumn("raw_return", F.ln(F.col("open_out") / F.col("open_in"))).drop("open_in", "open_out")
    out = cross_sectional_demean(raw, "raw_return", output=S.LABEL)
    if vol_scale:
        t = Trailing()
        returns = bars.withColumn("_ret", ln_pos("close") - t.lag(ln_pos("close")))
        vol = returns.select(S.TICKER, F.col(S.SESSION).alias(S.DECISION), (
            t.std("_ret", vol_window, vol_window // 2, shift=1) * F.sqrt(F.lit(252.0))).alias("_vol"))
        out = out.join(vol, [S.DECISION, S.TICKER], "left").withColumn(S.LABEL, div(S.LABEL, "_vol")).drop("_vol")
    return out.filter(F.col(S.LABEL).isNotNull()).select(
        S.DECISION, S.TICKER, S.ENTRY, S.EXIT, "raw_return", S.LABEL,
        F.col(S.ENTRY).alias(S.T0), F.col(S.EXIT).alias(S.T1), F.lit(1.0).alias(S.WEIGHT))


def forward_returns(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Realised open-to-open simple return of each (decision, ticker)."""
    pairs = _open_pairs(bars, grid).filter("open_in > 0 and open_out is not null")
    return pairs.select(S.DECISION, S.TICKER, (F.col("open_out") / F.col("open_in") - 1.0).alias("forward_return"))


def _per_span(labels: DataFrame, date: str = S.DECISION) -> DataFrame:
    """Row count of each (decision, span): every weight below depends on these alone, and they are few."""
    return labels.groupBy(date, S.T0, S.T1).agg(F.count("*").alias("n"))


def _mean_one(spans: DataFrame, column: str) -> DataFrame:
    """Scale a per-span weight so that its mean over rows is one; the window runs over the small span table."""
    every = Window.partitionBy()
    mean = F.sum(F.col(column) * F.col("n")).over(every) / F.sum("n").over(every)
    return spans.withColumn(column, F.coalesce(div(column, mean), F.col(column)))


def _uniqueness(spans: DataFrame, output: str) -> DataFrame:
    """Mean inverse concurrency over the end points inside each span.

    Prefix sums over the ordered end points give each span its mean in two look-ups; spans are never compared with
    each other.
    """
    ends = spans.select(F.explode(F.array(
        F.struct(F.col(S.T0).alias("d"), F.col("n").alias("opens"), F.lit(0).alias("closes")),
        F.struct(F.col(S.T1).alias("d"), F.lit(0).alias("opens"), F.col("n").alias("closes")))).alias("e")).select("e.*")
    points = ends.groupBy("d").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    upto = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per end point date
    active = F.sum("opens").over(upto) - (F.sum("closes").over(upto) - F.col("closes"))
    points = points.withColumn("inv", div(F.lit(1.0), active.cast("double")))
    points = points.select("d", F.sum("inv").over(upto).alias("s"), F.row_number().over(Window.orderBy("d")).alias("k"), "inv")
    first = points.select(F.col("d").alias(S.T0), F.col("s").alias("s0"), F.col("k").alias("k0"), F.col("inv").alias("i0"))
    last = points.select(F.col("d").alias(S.T1), F.col("s").alias("s1"), F.col("k").alias("k1"))
    weight = (F.col("s1") - F.col("s0") + F.col("i0")) / (F.col("k1") - F.col("k0") + 1)
    joined = spans.join(first, S.T0).join(last, S.T1)
    return _mean_one(joined.select(*spans.columns, weight.alias(output)), output)


def _recency(spans: DataFrame, output: str, half_life_weeks: float, date: str) -> DataFrame:
    newest = F.max(date).over(Window.partitionBy())
    age = F.datediff(newest, date) / F.lit(7.0)
    return _mean_one(spans.withColumn(output, F.pow(F.lit(0.5), age / F.lit(max(half_life_weeks, 1e-6)))), output)


def _attach(labels: DataFrame, spans: DataFrame, outputs: list[str], date: str = S.DECISION) -> DataFrame:
    keys = [date, S.T0, S.T1]
    kept = [c for c in labels.columns if c not in outputs]
    return labels.select(*kept).join(spans.select(*keys, *outputs), keys).select(*kept, *outputs)


def uniqueness_weights(labels: DataFrame, *, output: str = "uniqueness") -> DataFrame:
    """Average uniqueness of each label's span, scaled to mean one."""
    return _attach(labels, _uniqueness(_per_span(labels), output), [output])


def recency_weights(labels: DataFrame, *, half_life_weeks: float = 104.0, output: str = "recency") -> DataFrame:
    """Half-life decay by age from the newest decision, scaled to mean one."""
    return _attach(labels, _recency(_per_span(labels), output, half_life_weeks, S.DECISION), [output])


def training_weights(labels: DataFrame, *, half_life_weeks: float = 104.0, output: str = S.WEIGHT) -> DataFrame:
    """Uniqueness times recency, scaled to mean one, with one aggregate and one join over the labels."""
    spans = _recency(_uniqueness(_per_span(labels), "uniqueness"), "recency", half_life_weeks, S.DECISION)
    spans = _mean_one(spans.withColumn(output, F.col("uniqueness") * F.col("recency")), output)
    return _attach(labels, spans, ["uniqueness", "recency", output])


def combine_weights(df: DataFrame, columns: list[str], *, output: str = S.WEIGHT) -> DataFrame:
    """Product of any row weights, scaled to mean one (the mean is one row, joined to every row)."""
    product = F.lit(1.0)
    for c in columns:
        product = product * F.col(c)
    out = df.withColumn(output, product)
    mean = out.agg(F.avg(output).alias("_mean"))
    return out.crossJoin(F.broadcast(mean)).withColumn(output, F.coalesce(div(output, "_mean"), F.col(output))).drop("_mean")
