"""Purged walk-forward and combinatorial folds as tables, and the checks that they do not leak.

A fold assignment is a table (fold, role, decision, ticker). The calendar part of a fold, which weeks it trains and
tests on, is worked out on the table of distinct weeks; panel rows meet it in an equi-join on the decision.
"""

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.session import materialise

KEYS = (S.DECISION, S.TICKER)


def embargo_sessions(hold: int, embargo_weeks: int, sessions_per_week: int = 5) -> int:
    return hold + embargo_weeks * sessions_per_week


def _weeks(panel: DataFrame) -> DataFrame:
    """Distinct decisions with their 0-based index and the number of weeks; one row per week of the calendar."""
    return panel.select(S.DECISION).distinct().select(
        S.DECISION, (F.row_number().over(Window.orderBy(S.DECISION)) - 1).alias("week"),
        F.count("*").over(Window.partitionBy()).alias("n_weeks"))


def walk_forward_weeks(panel: DataFrame, *, train_weeks: int = 156, test_weeks: int = 26, expanding: bool = True,
                       min_train_weeks: int = 104) -> DataFrame:
    """(fold, role, decision): the weeks each fold may train on and tests on."""
    first = max(min_train_weeks, train_weeks) if expanding else train_weeks
    weeks = _weeks(panel)
    sized = weeks.select("n_weeks").distinct().filter(F.col("n_weeks") >= min_train_weeks + test_weeks)
    last_fold = F.floor((F.col("n_weeks") - 1 - first) / test_weeks).cast("int")
    folds = sized.filter(F.col("n_weeks") > first).select(
        "n_weeks", F.explode(F.sequence(F.lit(0), last_fold)).alias("fold"))
    start = F.lit(first) + F.col("fold") * test_weeks
    folds = folds.select("fold", start.alias("test_from"), F.least(start + test_weeks, F.col("n_weeks")).alias("test_to"))
    folds = folds.filter(F.col("test_to") - F.col("test_from") >= max(1, test_weeks // 4))
    train_from = F.lit(0) if expanding else F.col("test_from") - train_weeks
    spread = folds.select("fold", F.explode(F.array(
        F.struct(F.lit("train").alias("role"), F.sequence(train_from, F.col("test_from") - 1).alias("w")),
        F.struct(F.lit("test").alias("role"), F.sequence("test_from", F.col("test_to") - 1).alias("w")))).alias("r"))
    spread = spread.select("fold", "r.role", F.explode("r.w").alias("week"))
    return spread.join(weeks.select("week", S.DECISION), "week").select("fold", "role", S.DECISION)


def combinatorial_weeks(panel: DataFrame, *, n_groups: int = 8, n_test_groups: int = 2) -> DataFrame:
    """(fold, role, decision) for every choice of test groups among equal runs of weeks.

    The first ``n_weeks mod n_groups`` groups are one week longer.
    """
    weeks = _weeks(panel).filter(F.col("n_weeks") >= 2 * n_groups)
    short = F.floor(F.col("n_weeks") / n_groups)
    extra = F.col("n_weeks") - short * n_groups
    head = extra * (short + 1)
    group = F.when(F.col("week") < head, F.floor(F.col("week") / (short + 1))).otherwise(
        extra + F.floor((F.col("week") - head) / short)).cast("int")
    chosen = F.array(*[
        F.struct(F.lit(i).alias("fold"), F.array(*[F.lit(g) for g in combo]).alias("groups"))
        for i, combo in enumerate(combinations(range(n_groups), n_test_groups))])
    out = weeks.select(S.DECISION, group.alias("g"), F.explode(chosen).alias("c"))
    return out.select(F.col("c.fold").alias("fold"), F.when(
        F.array_contains("c.groups", F.col("g")), "test").otherwise("train").alias("role"), S.DECISION)


def assign_folds(panel: DataFrame, fold_weeks: DataFrame, *, embargo_weeks: int = 2, both_sides: bool = False,
                 per_block: bool = False) -> DataFrame:
    """(fold, role, decision, ticker) with role in train, test, purged, embargoed.

    Purge: a training label touching the test span. Embargo: a training label ending in the gap before the span (and,
    on both sides, starting in the gap after it). Test spans are one row per fold, or with ``per_block`` one per
    unbroken run of test weeks, so they reach the rows as a small per-fold list. A role depends on the decision and the span of
    the label alone: roles are worked out for these and meet the rows in one join.
    """
    return _spread(panel, _roles(_label_spans(panel), fold_weeks, embargo_weeks, both_sides, per_block))


def _label_spans(panel: DataFrame) -> DataFrame:
    """(decision, label_t0, label_t1, n): the different spans of labels and their rows; a few for each decision of the calendar."""
    return materialise(panel.groupBy(S.DECISION, S.T0, S.T1).agg(F.count("*").alias("n")), "spans")


def _roles(rows: DataFrame, fold_weeks: DataFrame, embargo_weeks: int, both_sides: bool, per_block: bool) -> DataFrame:
    """(fold, role, decision, label_t0, label_t1, n) from the spans of labels."""
    weeks = _weeks(rows).select(S.DECISION, "week")
    rows = rows.join(fold_weeks, S.DECISION)
    if per_block:
        test = fold_weeks.filter("role = 'test'").join(weeks, S.DECISION)
        run = F.col("week") - F.row_number().over(Window.partitionBy("fold").orderBy("week"))
        block = test.select("fold", S.DECISION, run.alias("block"))
        spans = rows.filter("role = 'test'").join(block, ["fold", S.DECISION]).groupBy("fold", "block")
    else:
        spans = rows.filter("role = 'test'").groupBy("fold", F.lit(0).alias("block"))
    spans = spans.agg(F.min(S.T0).alias("lo"), F.max(S.T1).alias("hi")).filter("lo is not null and hi is not null")
    spans = spans.groupBy("fold").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    days = embargo_weeks * 7
    t0, t1 = F.col(S.T0), F.col(S.T1)
    overlap = lambda s: (t0 <= s["hi"]) & (t1 >= s["lo"])

    def near(s):
        before = (t1 >= F.date_sub(s["lo"], days)) & (t1 < s["lo"])
        after = (t0 > s["hi"]) & (t0 <= F.date_add(s["hi"], days))
        return (before | after) if both_sides else before

    touches = lambda test: F.coalesce(F.exists("spans", test), F.lit(False))
    role = (
        F.when(F.col("role") == "test", "test")
        .when(touches(overlap), "purged").when(touches(near), "embargoed").otherwise("train")
    )
    return rows.join(spans, "fold").select("fold", role.alias("role"), S.DECISION, S.T0, S.T1, "n")


def _spread(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """The rows of the panel with the roles of their spans."""
    of = F.broadcast(roles.select("fold", "role", F.col(S.DECISION).alias("_d"), F.col(S.T0).alias("_t0"), F.col(S.T1).alias("_t1")))  # a few rows for each fold and decision
    same = (F.col(S.DECISION) == F.col("_d")) & F.col(S.T0).eqNullSafe(F.col("_t0")) & F.col(S.T1).eqNullSafe(F.col("_t1"))
    return panel.select(*KEYS, S.T0, S.T1).join(of, same).select("fold", "role", *KEYS, S.T0, S.T1)


def walk_forward_folds(panel: DataFrame, *, embargo_weeks: int = 2, **weeks) -> DataFrame:
    """Walk-forward assignment; folds left without training or test rows drop out and the rest are renumbered."""
    rows = _label_spans(panel)
    made = _roles(rows, walk_forward_weeks(rows, **weeks), embargo_weeks, False, False)
    return _spread(panel, _usable(made, renumber=True))


def combinatorial_folds(panel: DataFrame, *, n_groups: int = 8, n_test_groups: int = 2, embargo_weeks: int = 2,
                        per_block: bool = False) -> DataFrame:
    rows = _label_spans(panel)
    weeks = combinatorial_weeks(rows, n_groups=n_groups, n_test_groups=n_test_groups)
    return _spread(panel, _usable(_roles(rows, weeks, embargo_weeks, True, per_block), renumber=False))


def _usable(made: DataFrame, *, renumber: bool) -> DataFrame:
    rows = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0))
    good = made.groupBy("fold").agg(rows("train").alias("a"), rows("test").alias("b")).filter("a > 0 and b > 0")
    number = (F.row_number().over(Window.orderBy("fold")) - 1) if renumber else F.col("fold")  # one row per fold
    good = good.select("fold", number.cast("int").alias("_new"))
    return made.join(good, "fold").withColumn("fold", F.col("_new")).drop("_new")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Bounds and counts of each fold."""
    role = lambda r: F.col("role") == r
    candidate = F.col("role") != "test"
    return folds.groupBy("fold").agg(
        F.count_if(role("train")).alias("n_train"), F.count_if(role("test")).alias("n_test"),
        F.count_if(role("purged")).alias("purged"), F.count_if(role("embargoed")).alias("embargoed"),
        F.min(F.when(candidate, F.col(S.DECISION))).alias("train_start"),
        F.max(F.when(candidate, F.col(S.DECISION))).alias("train_end"),
        F.min(F.when(role("test"), F.col(S.DECISION))).alias("test_start"),
        F.max(F.when(role("test"), F.col(S.DECISION))).alias("test_end"))


def overlap_report(folds: DataFrame, *, embargo_weeks: int = 0) -> DataFrame:
    """Per fold: training labels that touch the test span, and that end inside the embargo before it."""
    spans = folds.filter("role = 'test'").groupBy("fold").agg(F.min(S.T0).alias("lo"), F.max(S.T1).alias("hi"))
    train = folds.filter("role = 'train'").join(spans, "fold")
    t0, t1, lo, hi = (F.col(c) for c in (S.T0, S.T1, "lo", "hi"))
    return train.groupBy("fold").agg(
        F.count_if((t0 <= hi) & (t1 >= lo)).alias("n_overlapping"),
        F.count_if((t1 >= F.date_sub(lo, embargo_weeks * 7)) & (t1 < lo)).alias("n_in_embargo"))


def verify_no_overlap(folds: DataFrame, *, embargo_weeks: int = 0) -> None:
    bad = overlap_report(folds, embargo_weeks=embargo_weeks).filter(
        "n_overlapping > 0" + (" or n_in_embargo > 0" if embargo_weeks else "")).collect()  # at most one row per fold
    if bad:
        raise AssertionError("; ".join(
            f"fold {r.fold}: {r.n_overlapping} overlapping, {r.n_in_embargo} inside the embargo" for r in bad))


def lookahead_differences(bars: DataFrame, cutoff: str, columns: list[str]) -> DataFrame:
    """Per feature, how many names have another value at the cut-off once later bars are removed."""
    from tidemark.plans.panel import raw_features

    day = bars.filter(F.col(S.SESSION) == F.lit(cutoff).cast("date")).select(S.SESSION).distinct()
    full = raw_features(bars, sessions=day).select(S.TICKER, *[F.col(c).alias(f"full_{c}") for c in columns])
    cut = raw_features(bars, sessions=day, asof=cutoff).select(S.TICKER, *[F.col(c).alias(f"cut_{c}") for c in columns])
    both = full.join(cut, S.TICKER, "full")
    counts = both.agg(F.count("*").alias("n"), *[
        F.count_if(~F.col(f"full_{c}").eqNullSafe(F.col(f"cut_{c}"))).alias(c) for c in columns])
    return counts.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_different")) for c in columns])).alias("r")).select(
            "r.feature", F.col("n").alias("n_compared"), "r.n_different")
