"""Roles of folds are worked out for the spans of labels, not for every row."""

from datetime import date, timedelta

import pandas as pd
import pytest

from tidemark.operators import ablation, splits

FIRST = date(2020, 1, 3)


def _panel(spark):
    day = lambda k: FIRST + timedelta(7 * k)
    rows = [(day(w), f"t{i}", day(w) + timedelta(1), day(w) + timedelta(8 if i % 3 else 15)) for w in range(12) for i in range(6)]
    rows.append((day(2), "none", None, None))
    return spark.createDataFrame(rows, "decision_session date, ticker string, label_t0 date, label_t1 date"), rows


@pytest.mark.parametrize("both", [False, True])
def test_roles_of_rows_with_different_spans(spark, both):
    panel, rows = _panel(spark)
    weeks = splits.combinatorial_weeks(panel, n_groups=4, n_test_groups=1)
    made = splits.assign_folds(panel, weeks, embargo_weeks=1, both_sides=both)
    top = "\n".join(made._jdf.queryExecution().executedPlan().toString().splitlines()[:6])
    assert "BroadcastHashJoin [decision_session" in top and "Exchange hashpartitioning" not in top
    got = {(r.fold, r.decision_session, r.ticker): r.role for r in made.collect()}
    part = {(r.fold, r.decision_session): r.role for r in weeks.collect()}
    want = {}
    for fold in {k for k, _ in part}:
        tested = [(a, b) for d, _, a, b in rows if part[fold, d] == "test" and a]
        lo, hi = min(a for a, _ in tested), max(b for _, b in tested)
        for d, t, a, b in rows:
            role = part[fold, d]
            if role == "train" and a and a <= hi and b >= lo:
                role = "purged"
            elif role == "train" and a and (lo - timedelta(7) <= b < lo or (both and hi < a <= hi + timedelta(7))):
                role = "embargoed"
            want[fold, d, t] = role
    assert got == want


def test_sets_of_rows_are_counted_once(spark):
    panel, _ = _panel(spark)
    folds = splits.combinatorial_folds(panel.where("label_t0 is not null"), n_groups=4, n_test_groups=1, embargo_weeks=1)
    members, marks = ablation.row_sets(folds)
    used = folds.where("role in ('train', 'test')").toPandas()
    assert marks.groupBy().sum("k").first()[0] == len(used)
    back = marks.join(members, ["set", "decision_session"]).select("fold", "role", "decision_session", "ticker").toPandas()
    order = ["fold", "role", "decision_session", "ticker"]
    pd.testing.assert_frame_equal(back.sort_values(order, ignore_index=True), used[order].sort_values(order, ignore_index=True))
