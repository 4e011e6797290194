"""Ridge for all folds from one pass over the panel.

A row trains a set of folds; rows of the same set are added up together, so the panel is read once however many folds there are and
purging costs nothing: a purged row's set lacks the fold. What is added up are weighted products of the features (zero where missing),
of the marks of what is missing, and of the label. A fold's sums are those of all sets that hold it; its medians fill what is missing
by algebra, on matrices of the size of the features.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import ranks
from tidemark.operators.models import MIN_LABELS, shuffle_labels
from tidemark.session import materialise

KEYS = [S.DECISION, S.TICKER]


def training_sets(panel: DataFrame, folds: DataFrame, columns: list[str]) -> DataFrame:
    """The labelled rows that train any fold: ``set`` (numbers of the folds, comma-joined), weight, label and features."""
    sets = folds.where("role = 'train'").groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_set(F.col("fold").cast("int"))), ",").alias("set"))
    return _training_rows(panel.where(F.col(S.LABEL).isNotNull()).join(sets, KEYS), panel.columns, columns)


def _training_rows(rows: DataFrame, known: list[str], columns: list[str]) -> DataFrame:
    weight = F.coalesce(F.col(S.WEIGHT), F.lit(1.0)) if S.WEIGHT in known else F.lit(1.0)
    return rows.select("set", weight.cast("double").alias("w"), F.col(S.LABEL).cast("double").alias("y"),
                       *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def _moments(p: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            table = batch.to_pandas()
            x = table[[f"x{i}" for i in range(p)]].to_numpy(float)
            lacks = np.isnan(x)
            z = np.concatenate([np.where(lacks, 0.0, x), lacks, table[["y"]].to_numpy(float), np.ones((len(x), 1))], axis=1)
            codes, names = pd.factorize(table["set"])
            for k, name in enumerate(names):
                part, w = z[codes == k], table["w"].to_numpy()[codes == k]
                made = (part * w[:, None]).T @ part
                made[-1, -1] = len(part)  # the number of labels
                sums[name] = sums[name] + made if name in sums else made
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["set", "m"])

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m) for m in table["m"].to_pylist())
    return pa.table({"set": [key[0].as_py()], "m": pa.array([total.tobytes()], pa.binary())})


def fit_folds(panel: DataFrame, folds: DataFrame, columns: list[str], *, alpha: float | dict[str, float] = 10.0, min_labels: int = MIN_LABELS) -> DataFrame:
    """(fold, n, coefficients, fills): ridge without intercept for each fold; null coefficients with fewer than ``min_labels`` labels.

    Missing features take the median of the fold's labelled training rows, or 0 where there is none. ``alpha`` may name several penalties:
    then there is a row for each fold and ``candidate``, from the same sums.
    """
    return _solve(materialise(training_sets(panel, folds, columns), "training"), _folds_of(folds), columns, alpha, min_labels)


def fit_shuffled(panel: DataFrame, folds: DataFrame, columns: list[str], *, seed: int = 7, alpha: float = 10.0, min_labels: int = MIN_LABELS) -> DataFrame:
    """As ``fit_folds``, on labels permuted within each week, for each fold on its own. Here a row is repeated for each fold it trains."""
    known = panel.where(F.col(S.LABEL).isNotNull()).join(folds.where("role = 'train'").select(F.col("fold").cast("int").alias("fold"), *KEYS), KEYS)
    mixed = shuffle_labels(known, by=("fold", S.DECISION), seed=seed)
    rows = _training_rows(mixed.withColumn("set", F.col("fold").cast("string")), panel.columns, columns)
    return _solve(materialise(rows, "training"), _folds_of(folds), columns, alpha, min_labels)


def _folds_of(folds: DataFrame) -> list[int]:
    return sorted(r.fold for r in folds.select(F.col("fold").cast("int").alias("fold")).distinct().collect())  # one row for each fold


def _solve(rows: DataFrame, every: list[int], columns: list[str], alpha, min_labels: int) -> DataFrame:
    spark, p = rows.sparkSession, len(columns)
    # one matrix for each partition and set, added up by set; one matrix for each set reaches the driver
    parts = rows.mapInArrow(_moments(p), "set string, m binary")
    added = {r["set"]: np.frombuffer(r.m).reshape(2 * p + 2, -1) for r in parts.groupBy("set").applyInArrow(_add, "set string, m binary").collect()}
    of = {k: sum((m for s, m in added.items() if str(k) in s.split(",")), np.zeros((2 * p + 2, 2 * p + 2))) for k in every}
    medians = _medians(rows, p)
    several = alpha if isinstance(alpha, dict) else {"": alpha}
    out = []
    for k in every:
        m, f = of[k], np.array([medians.get((k, i), 0.0) for i in range(p)])
        n = int(m[-1, -1])
        xx, xm, mm = m[:p, :p], m[:p, p:2 * p], m[p:2 * p, p:2 * p]
        gram, moment = xx + xm * f + (xm * f).T + f[:, None] * mm * f, m[:p, 2 * p] + f * m[p:2 * p, 2 * p]
        for name, penalty in several.items():
            out.append((k, name, n, np.linalg.solve(gram + penalty * np.eye(p), moment).tolist() if n >= min_labels else None, f.tolist()))
    made = spark.createDataFrame(out, "fold int, candidate string, n bigint, coefficients array<double>, fills array<double>")
    return made if isinstance(alpha, dict) else made.drop("candidate")


def _medians(rows: DataFrame, p: int) -> dict[tuple[int, int], float]:
    """Exact medians by (fold, feature). Buckets of values are counted by set before they are repeated for the folds of the set; only the
    values of the one or two buckets that hold a median are shuffled."""
    folds = F.explode(F.split("set", ",").cast("array<int>")).alias("fold")
    blocks = ranks.bucket_counts(rows, "set", p).groupBy("set", "i", "_bucket").agg(F.sum("k").alias("k"))
    blocks = blocks.select(folds, "i", "_bucket", "k").groupBy("fold", "i", "_bucket").agg(F.sum("k").alias("_block"))
    held = ranks.holding_buckets(blocks, ["fold", "i"], [0.5])
    kept = held.collect()  # one or two rows for each fold and feature
    wanted: dict[int, set[int]] = {}
    for r in kept:
        wanted.setdefault(r["i"], set()).add(r["_bucket"])
    near = ranks.values_within(rows, "set", p, {i: sorted(b) for i, b in wanted.items()})
    counted = near.groupBy("set", "i", "_bucket", "v").agg(F.sum("k").alias("k")).select(folds, "i", "_bucket", "v", "k")
    held = rows.sparkSession.createDataFrame(kept, held.schema)
    spread = counted.join(F.broadcast(held), ["fold", "i", "_bucket"]).groupBy("fold", "i", "v", "_bucket", "_below", "n_total").agg(F.sum("k").alias("n_equal"))
    found = ranks.quantiles_in(spread, ["fold", "i"], "v", [0.5]).collect()  # one row for each fold and feature
    return {(r.fold, r.i): r.q[0] for r in found}


def with_fold_score(rows: DataFrame, fitted: DataFrame, columns: list[str], output: str = S.PREDICTION) -> DataFrame:
    """``rows`` (with ``fold``) with the score of their fold's fit, null where it has none; with a ``candidate`` there, a row for each."""
    of = F.broadcast(fitted.select(F.col("fold").alias("_fold"), *(["candidate"] if "candidate" in fitted.columns else ()), "coefficients", "fills"))  # one row for each fit
    beta, fill = F.col("coefficients"), F.col("fills")
    value = sum((beta[i] * F.coalesce(F.col(c).cast("double"), fill[i]) for i, c in enumerate(columns)), F.lit(0.0))
    return rows.join(of, F.col("fold") == F.col("_fold"), "left").withColumn(output, F.when(beta.isNotNull(), value)).drop("_fold", "coefficients", "fills")


def score_folds(panel: DataFrame, folds: DataFrame, fitted: DataFrame, columns: list[str], output: str = S.PREDICTION) -> DataFrame:
    """The test rows of every fold with the prediction of that fold's fit, all folds in one plan; null where the fold has no fit."""
    return with_fold_score(panel.join(folds.where("role = 'test'").select("fold", *KEYS), KEYS), fitted, columns, output)


def walk_forward_ridge(panel: DataFrame, folds: DataFrame, columns: list[str], **options) -> DataFrame:
    """Out-of-sample predictions of ridge: one fit for each fold, none of them a job of its own."""
    return score_folds(panel, folds, fit_folds(panel, folds, columns, **options), columns)


def coefficient_table(fitted: DataFrame, columns: list[str]) -> DataFrame:
    """(fold, feature, coefficient, importance): signed coefficients, and their sizes as importances."""
    named = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), F.col("coefficients").alias("coefficient"))
    rows = fitted.where("coefficients is not null").select("fold", F.explode(named).alias("r"))
    return rows.select("fold", F.col("r.feature").alias("feature"), F.col("r.coefficient").alias("coefficient"), F.abs("r.coefficient").alias("importance"))
