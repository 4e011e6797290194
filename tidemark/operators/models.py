"""Models as MLlib pipelines and column expressions, and the walk-forward around them."""

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.operators import boosting

MIN_LABELS = 200
# The published-factor baseline.
MOMENTUM_WEIGHTS = {"reversal_1w": 0.5, "mom_12w": 0.3, "mom_52w_skip4w": 0.2}


def fill_medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the training rows only; one number per feature reaches the driver."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = train.select(F.explode(pairs).alias("p")).select("p.i", "p.v")
    found = {r.i: r.q[0] for r in ranks.quantiles(long, ["i"], "v", [0.5]).collect()}  # one row per feature
    return {c: float(found[i]) if found.get(i) is not None else 0.0 for i, c in enumerate(columns)}


class Fitted:
    """A fitted pipeline with the fill values and features it needs; null features take the training median, then 0."""

    def __init__(self, model, columns: list[str], fills: dict[str, float]):
        self.model, self.columns, self.fills = model, columns, fills

    def predict(self, df: DataFrame, output: str = S.PREDICTION) -> DataFrame:
        missing = set(self.columns) - set(df.columns)
        if missing:
            raise ValueError(f"panel lacks features the model was fitted on: {sorted(missing)}")
        filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c), F.lit(self.fills[c])) for c in self.columns})
        scored = self.model.transform(filled)
        return scored.withColumnRenamed("_prediction", output).drop("_features", *[f"_x_{c}" for c in self.columns])

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.columns, map(float, self.model.stages[-1].coefficients)))

    def importance(self) -> dict[str, float]:
        last = self.model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else [abs(v) for v in last.coefficients]
        return dict(sorted(zip(self.columns, map(float, values)), key=lambda kv: -kv[1]))


def _fit(train: DataFrame, columns: list[str], regressor) -> Fitted:
    fills = fill_medians(train, columns)
    rows = train.filter(F.col(S.LABEL).isNotNull()).select(
        S.LABEL, F.coalesce(F.col(S.WEIGHT), F.lit(1.0)).alias(S.WEIGHT) if S.WEIGHT in train.columns else F.lit(1.0).alias(S.WEIGHT),
        *[F.coalesce(F.col(c), F.lit(fills[c])).alias(f"_x_{c}") for c in columns])
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_features")
    return Fitted(Pipeline(stages=[assembler, regressor]).fit(rows), columns, fills)


def ridge(train: DataFrame, columns: list[str], alpha: float = 10.0) -> Fitted:
    """Ridge without intercept. MLlib scales its penalty by the label's deviation and the total weight; undo both."""
    weight = F.coalesce(F.col(S.WEIGHT), F.lit(1.0)) if S.WEIGHT in train.columns else F.lit(1.0)
    y = F.col(S.LABEL)
    n, s1, s2 = train.filter(y.isNotNull()).agg(F.sum(weight), F.sum(weight * y), F.sum(weight * y * y)).first()
    spread = max(s2 / n - (s1 / n) ** 2, 0.0) ** 0.5
    return _fit(train, columns, LinearRegression(
        featuresCol="_features", labelCol=S.LABEL, weightCol=S.WEIGHT, predictionCol="_prediction", elasticNetParam=0.0,
        fitIntercept=False, standardization=False, solver="normal", regParam=alpha / n * spread))


def boosted_trees(train: DataFrame, columns: list[str], **options) -> boosting.Boosted:
    """Gradient-boosted trees with a leaf penalty; missing features stay missing."""
    return boosting.fit(train, columns, **options)


def factory(name: str, columns: list[str], **options) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """``fit(train)`` of a model by name: ridge, boosted_trees, momentum, zero or random."""
    fits = {"ridge": lambda train: ridge(train, columns, **options).predict, "boosted_trees": lambda train: boosted_trees(train, columns, **options).predict,
            "momentum": lambda train: lambda df: momentum_score(df, **options), "zero": lambda train: zero_score,
            "random": lambda train: lambda df: random_score(df, **options)}
    if name not in fits:
        raise ValueError(f"no model {name}; known are {sorted(fits)}")
    return fits[name]


def momentum_score(df: DataFrame, weights: dict[str, float] = MOMENTUM_WEIGHTS, output: str = S.PREDICTION) -> DataFrame:
    present = {c: w for c, w in weights.items() if c in df.columns}
    if not present:
        raise ValueError(f"momentum needs one of {sorted(weights)}")
    return df.withColumn(output, sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in present.items()), F.lit(0.0)))


def zero_score(df: DataFrame) -> DataFrame:
    return df.withColumn(S.PREDICTION, F.lit(0.0))


def random_score(df: DataFrame, seed: int = 7, output: str = S.PREDICTION) -> DataFrame:
    """Normal draws keyed by the row, so they do not depend on partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), S.DECISION, S.TICKER), F.lit(2**52)) + 0.5) / 2.0**52
    return df.withColumn(output, F.sqrt(-2.0 * F.ln(unit(1))) * F.cos(2.0 * F.pi() * unit(2)))


def shuffle_labels(train: DataFrame, *, by: tuple[str, ...] = (S.DECISION,), seed: int = 7, label: str = S.LABEL) -> DataFrame:
    """Labels permuted within each group, by pairing two keyed orders of its labelled rows.

    With the fold in ``by`` the permutations of different folds are independent. Both orders are orders of hashes of the row's key, so the
    result does not depend on partitioning, and rows are numbered in ranges of hashes: no group is one task. Rows without a label stay.
    """
    keys = list(by)
    rows = train.where(F.col(label).isNotNull())
    order = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys, S.TICKER)
    placed = rows
    for name, salt in (("_a", 1), ("_b", 2)):
        placed = ranks.numbered(placed, keys, [order(salt), F.col(S.TICKER), F.col(label)], order(salt), name)
    labels = placed.select(*keys, F.col("_b").alias("_a"), F.col(label).alias("_label"))
    moved = placed.join(labels, [*keys, "_a"]).withColumn(label, F.col("_label")).drop("_a", "_b", "_label")
    return moved.unionByName(train.where(F.col(label).isNull()))


def blend_scores(df: DataFrame, *, price: str = "price_score", news: str = "news_score", has_news: str = "has_news",
                 price_weight: float = 0.9, news_weight: float = 0.1, by=(S.DECISION,), keys=(S.DECISION, S.TICKER), method: str = "buckets") -> DataFrame:
    """Rank both scores and mix them; a row without news keeps its whole price rank. ``keys`` identify a row."""
    a, b = price_weight / (price_weight + news_weight), news_weight / (price_weight + news_weight)
    masked = df.withColumn("_n", F.when(F.col(has_news), F.col(news))).withColumn("_p", F.col(price))
    ranked = ranks.rank_pct(masked, list(by), ["_p", "_n"], keys=list(keys), method=method, suffix="_r")
    p, n = F.col("_p_r") - 0.5, F.col("_n_r") - 0.5
    return ranked.withColumn(S.PREDICTION, F.when(F.col(has_news), a * p + b * n).otherwise(p)).drop("_p", "_n", "_p_r", "_n_r")


def walk_forward_predict(panel: DataFrame, folds: DataFrame, fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]], *,
                         min_labels: int = MIN_LABELS) -> DataFrame:
    """Fit on each fold's training rows and score its test rows. Folds are few; each fit is a distributed job.

    ``fit(train, fold)`` returns a function that adds the prediction. ``panel`` should be a table, since every fold
    reads it. A fold with fewer than ``min_labels`` labels keeps its test rows, with a null prediction.
    """
    keys = [S.DECISION, S.TICKER]
    labelled = folds.filter("role = 'train'").join(panel.filter(F.col(S.LABEL).isNotNull()).select(*keys), keys)
    counts = folds.select("fold").distinct().join(labelled.groupBy("fold").agg(F.count("*").alias("n")), "fold", "left")
    out = None
    for fold, n in sorted((r.fold, r.n or 0) for r in counts.collect()):  # one row per fold
        rows = lambda role: panel.join(folds.filter((F.col("fold") == fold) & (F.col("role") == role)).select(*keys), keys)  # noqa: B023, E731
        scored = fit(rows("train"), fold)(rows("test")) if n >= min_labels else rows("test").withColumn(S.PREDICTION, F.lit(None).cast("double"))
        scored = scored.withColumn("fold", F.lit(fold))
        out = scored if out is None else out.unionByName(scored, allowMissingColumns=True)
    return out
