"""Variants of a model on identical folds, and candidates on combinatorial paths; the variant is a column, not a loop."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators import book, costs, fold_ridge, models, performance, skill
from tidemark.operators.cross_section import cross_sectional_demean
from tidemark.operators.evaluation import MIN_PATH_TEST, MIN_PATH_TRAIN
from tidemark.session import materialise

KEYS = [S.DECISION, S.TICKER]
VARIANTS = ("benchmark", "zero", "random", "shuffled", "momentum", "price_only", "news_only", "price_news")
SCENARIO = "scenario"


def variant_predictions(panel: DataFrame, folds: DataFrame, price: list[str], news: list[str] | tuple = (), *, variants: tuple[str, ...] = VARIANTS, alpha: float = 10.0,
                        seed: int = 7, weights: tuple[float, float] = (0.9, 0.1), min_labels: int = models.MIN_LABELS) -> DataFrame:
    """(scenario, fold, decision, ticker, label, prediction): the test rows of every fold under each variant.

    Folds with too few labels are left out for all variants. News models are fitted only on rows that have news, and only where a fold
    has enough of them; without such a fit, and for rows without news, the blend is the price rank. Without ``news`` columns the
    two news variants are absent. "benchmark" has no scores and no rows here.
    """
    fitted = materialise(fold_ridge.fit_folds(panel, folds, price, alpha=alpha, min_labels=min_labels), "fits")
    usable = F.broadcast(fitted.where("coefficients is not null").select(F.col("fold").alias("_f")))  # one row for each fold
    rows = panel.join(folds.where("role = 'test'").select(F.col("fold").cast("int").alias("fold"), *KEYS), KEYS)
    rows = rows.join(usable, F.col("fold") == F.col("_f")).drop("_f")
    made: dict[str, str] = {}
    for name in variants:
        out = f"_{name}"
        if name == "zero":
            rows = rows.withColumn(out, F.lit(0.0))
        elif name == "random":
            rows = models.random_score(rows, seed, out)
        elif name == "momentum":
            rows = models.momentum_score(rows, output=out)
        elif name == "price_only":
            rows = fold_ridge.with_fold_score(rows, fitted, price, out)
        elif name == "shuffled":
            rows = fold_ridge.with_fold_score(rows, fold_ridge.fit_shuffled(panel, folds, price, seed=seed, alpha=alpha, min_labels=min_labels), price, out)
        elif name not in ("benchmark", "news_only", "price_news"):
            raise ValueError(f"no variant {name}")
        elif name == "benchmark" or not news:
            continue
        made[name] = out
    if "news_only" in made or "price_news" in made:
        some = F.coalesce(*[F.col(c).cast("double") for c in news]).isNotNull()
        fit = fold_ridge.fit_folds(panel.where(some), folds, list(news), alpha=alpha, min_labels=min_labels)
        rows = fold_ridge.with_fold_score(rows, fit, list(news), "_news").withColumn("_has", some & F.col("_news").isNotNull())
        rows = rows.withColumn("_news_only", F.when(F.col("_has"), F.col("_news")))
        if "price_news" in made:
            priced = fold_ridge.with_fold_score(rows, fitted, price, "_price")
            rows = models.blend_scores(priced, price="_price", news="_news", has_news="_has", price_weight=weights[0], news_weight=weights[1], by=("fold", S.DECISION),
                                       keys=("fold", *KEYS)).withColumnRenamed(S.PREDICTION, "_price_news")
    each = F.array(*[F.struct(F.lit(name).alias(SCENARIO), F.col(c).cast("double").alias(S.PREDICTION)) for name, c in made.items()])
    return rows.select("fold", *KEYS, S.LABEL, F.explode(each).alias("v")).select("v.scenario", "fold", *KEYS, S.LABEL, "v.prediction").where("prediction is not null")


def ablation(predictions: DataFrame, forward: DataFrame, stats: DataFrame, fees: costs.Fees, *, capital: float = 1.0,
             size: Callable[[DataFrame], DataFrame] | None = None, hold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ledger, metrics) of the books of every variant, over the same weeks, after costs; ``hold`` adds the benchmark, which pays none.

    ``size(scores)`` makes weights of (scenario, decision, ticker, score); default is the inverse-volatility book with its limits. A
    variant that holds nothing in a week earns nothing there.
    """
    by = (SCENARIO, S.DECISION)
    scores = cross_sectional_demean(predictions.select(*by, S.TICKER, F.col(S.PREDICTION).alias("score")), "score", by=by)
    if size is None:
        risk = stats.select(*KEYS, "volatility")
        size = lambda s: book.build_book(s.join(risk, KEYS, "left"), by=by)
    books = materialise(size(scores).select(*by, S.TICKER, "weight"), "books")
    weeks = predictions.select(*by).distinct()
    paid = costs.rebalance_cost(books, weeks, stats, fees, capital=capital, by=(SCENARIO,))
    ledger = performance.weekly_ledger(books, forward, paid, weeks=weeks, capital=capital, by=(SCENARIO,))
    if hold:
        held = performance.benchmark(predictions.select(*KEYS).distinct(), forward).withColumn(SCENARIO, F.lit("benchmark"))
        ledger = ledger.unionByName(held, allowMissingColumns=True)
    ledger = materialise(ledger, "ledger")
    return ledger, performance.metrics(ledger)


def variant_skill(predictions: DataFrame, **options) -> DataFrame:
    """Summary of the weekly rank correlation of every variant, and with the fold as observation (``fold_ic``, ``fold_t``)."""
    weekly = materialise(skill.periodic_ic(predictions, by=(SCENARIO, "fold", S.DECISION), **options), "weekly-ic")
    by_fold = skill.ic_statistics(weekly.groupBy(SCENARIO, "fold").agg(F.avg("ic").alias("ic")), (SCENARIO,))
    by_fold = by_fold.select(SCENARIO, F.col("mean_ic").alias("fold_ic"), F.when(F.col("n_periods") > 1, F.col("t_stat")).otherwise(0.0).alias("fold_t"))
    return skill.ic_statistics(weekly, (SCENARIO,)).join(by_fold, SCENARIO)


def row_sets(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, decision, ticker) and (fold, role, decision, k, set): the different sets of rows that folds use of a week, each once.

    Most folds use a week whole or lack the same rows, so what is computed for a set serves many folds. Sets are told apart by their
    number of rows ``k`` and two hashes of 64 bits of all tickers.
    """
    used = folds.where("role in ('train', 'test')")
    h = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), S.TICKER))
    marks = materialise(used.groupBy("fold", "role", S.DECISION).agg(F.count("*").alias("k"), F.struct(F.count("*"), h(1), h(2)).cast("string").alias("set")), "sets")
    chosen = marks.groupBy(S.DECISION, "set").agg(F.min(F.struct("fold", "role")).alias("f")).select(S.DECISION, "set", "f.fold", "f.role")
    return used.join(chosen, ["fold", "role", S.DECISION]).select("set", *KEYS), marks


def path_skill(panel: DataFrame, folds: DataFrame, fixed: list[str] | tuple = (), ridges: dict[str, float] | None = None, columns: list[str] | tuple = (), *,
               min_names: int = 5, min_distinct: int = 3) -> DataFrame:
    """(path, candidate, in_sample, out_of_sample): mean weekly rank correlation of each candidate on each path, without a job for each.

    ``fixed`` candidates are columns of ``panel``: their weekly correlations are computed once for each set of rows that any path uses.
    ``ridges`` (name: penalty) are fitted on ``columns`` for all paths from one pass. Paths with too few labels have null scores.
    """
    labelled = panel.where(F.col(S.LABEL).isNotNull())
    known = materialise(folds.select("fold", "role", *KEYS).join(labelled.select(*KEYS), KEYS), "known")
    members, marks = row_sets(known)
    out = None
    if fixed:
        each = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias(S.PREDICTION)) for c in fixed])
        rows = members.join(labelled, KEYS).select("set", *KEYS, S.LABEL, F.explode(each).alias("v")).select("set", *KEYS, S.LABEL, "v.candidate", "v.prediction")
        weekly = skill.periodic_ic(rows, by=("candidate", "set", S.DECISION), min_names=min_names, min_distinct=min_distinct)
        out = marks.join(weekly, ["set", S.DECISION]).select("fold", "role", "candidate", "ic")
    if ridges:
        fitted = fold_ridge.fit_folds(panel, folds, list(columns), alpha=ridges, min_labels=MIN_PATH_TRAIN)
        rows = known.where("role in ('train', 'test')").select(F.col("fold").cast("int").alias("fold"), "role", *KEYS).join(labelled, KEYS)
        scored = fold_ridge.with_fold_score(rows, fitted, list(columns))
        weekly = skill.periodic_ic(scored, by=("candidate", "fold", "role", S.DECISION), min_names=min_names, min_distinct=min_distinct)
        weekly = weekly.select("fold", "role", "candidate", "ic")
        out = weekly if out is None else out.union(weekly)
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col("ic")))
    means = out.groupBy("fold", "candidate").agg(mean("train").alias("a"), mean("test").alias("b"))
    rows_of = lambda role: F.sum(F.when(F.col("role") == role, F.col("k")).otherwise(0))
    paths = known.select("fold").distinct().join(marks.groupBy("fold").agg(rows_of("train").alias("n"), rows_of("test").alias("m")), "fold", "left")
    paths = paths.fillna(0, ["n", "m"])
    every = paths.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in (*fixed, *(ridges or ()))])))
    fits = (F.col("n") >= MIN_PATH_TRAIN) & (F.col("m") >= MIN_PATH_TEST)
    return every.join(means, ["fold", "candidate"], "left").select(F.col("fold").alias("path"), "candidate", F.when(fits, F.col("a")).alias("in_sample"),
                                                                   F.when(fits, F.col("b")).alias("out_of_sample"))
