"""Operators against pandas, against brute force, and at their boundaries."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3):
        price = 100.0
        for i in range(120):
            price *= math.exp(rng.normal(0, 0.02))
            high, low = price * 1.01, price * 0.985
            rows.append((f"T{k}", date(2020, 1, 1) + timedelta(days=i), price * 0.995, high, low, price, 1000.0 + 10 * i))
    pdf = pd.DataFrame(rows, columns=["ticker", "session", "open", "high", "low", "close", "volume"])
    return pdf, spark.createDataFrame(pdf).cache()


def test_smoothing_equals_recursion(bars):
    from tidemark.operators.features import price_features

    pdf, df = bars
    got = price_features(df, blocks=("smoothing",)).toPandas().sort_values(["ticker", "session"], ignore_index=True)
    for ticker, g in pdf.groupby("ticker"):
        out = got[got.ticker == ticker].reset_index(drop=True)
        close = g["close"].reset_index(drop=True)
        span = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
        macd = span(close, 12) - span(close, 26)
        np.testing.assert_allclose(out["macd_norm"], macd / close, rtol=1e-9, atol=1e-14)
        np.testing.assert_allclose(out["macd_hist_norm"], (macd - span(macd, 9)) / close, rtol=1e-8, atol=1e-13)
        assert (out["rsi_14"][:14] == 0).all()


def test_moments_equal_pandas(bars):
    from tidemark.operators.features import price_features

    pdf, df = bars
    got = price_features(df, blocks=("moments", "price")).toPandas().sort_values(["ticker", "session"], ignore_index=True)
    for ticker, g in pdf.groupby("ticker"):
        ret = np.log(g["close"]).diff().reset_index(drop=True)
        out = got[got.ticker == ticker].reset_index(drop=True)
        np.testing.assert_allclose(out["skew_13w"], ret.rolling(65, min_periods=40).skew(), rtol=1e-8)
        np.testing.assert_allclose(out["kurt_13w"], ret.rolling(65, min_periods=40).kurt(), rtol=1e-8)
        np.testing.assert_allclose(out["vol_13w"], ret.rolling(65, min_periods=40).std() * math.sqrt(252), rtol=1e-9)


def test_visibility_boundaries(spark):
    from tidemark.operators.visibility import LookAheadError, assert_pit, visible_bars, visible_news

    at = datetime(2024, 1, 5, 21)
    df = spark.createDataFrame([(at - timedelta(minutes=1),), (at,), (at + timedelta(minutes=1),)], "available_at timestamp")
    assert visible_bars(df, "2024-01-05 21:00:00").count() == 2
    assert visible_news(df, "2024-01-05 21:00:00").count() == 1
    with pytest.raises(LookAheadError):
        assert_pit(df, "2024-01-05 21:00:00")


def test_bucketed_ranks_equal_pandas(spark):
    from tidemark.functions.ranks import quantiles, rank_pct

    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1e3, 300), np.zeros(100), rng.normal(0, 1e-5, 100), [np.nan] * 20])
    pdf = pd.DataFrame({"g": ["a"] * len(v), "ticker": [f"t{i}" for i in range(len(v))], "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    want = pdf.set_index("ticker")["v"].rank(pct=True)
    for method in ("window", "buckets"):
        got = rank_pct(df, ["g"], ["v"], method=method).toPandas().set_index("ticker")["v"].reindex(want.index)
        np.testing.assert_allclose(got, want, rtol=1e-12)
        q = quantiles(df, ["g"], "v", [0.02, 0.37, 0.98], method=method).first()["q"]
        np.testing.assert_allclose(q, np.nanquantile(v, [0.02, 0.37, 0.98]), rtol=1e-9)


def _articles(spark):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(40)]
    rows, texts = [], []
    for i in range(60):
        if texts and rng.random() < 0.5:
            text = texts[rng.integers(len(texts))].split()
            text[rng.integers(len(text))] = words[rng.integers(40)]
            text = " ".join(text)
        else:
            text = " ".join(rng.choice(words, 12))
        texts.append(text)
        rows.append((f"h{i}", "AB"[i % 2], text, "", datetime(2024, 1, 1) + timedelta(hours=int(3 * i + rng.integers(3)))))
    return rows, spark.createDataFrame(rows, "content_hash string, ticker string, title string, body string, available_at timestamp")


def _grams(text):
    return {text[i:i + 5] for i in range(len(text) - 4)}


def test_deduplicate_equals_greedy_scan(spark):
    from tidemark.operators.dedupe import deduplicate

    rows, df = _articles(spark)
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[4])):
        g = _grams(r[2])
        near = [k for k in kept if k[1] == r[1] and r[4] - k[4] <= timedelta(hours=72)
                and len(g & _grams(k[2])) / len(g | _grams(k[2])) >= 0.6]
        if not near:
            kept.append(r)
    assert {r.content_hash for r in deduplicate(df).collect()} == {r[0] for r in kept}


def test_book_volatility_equals_matrix(spark):
    from tidemark.operators.book import portfolio_volatility, shrunk_covariance

    rng = np.random.default_rng(2)
    rows = [(date(2024, 1, 5), date(2022, 1, 7) + timedelta(weeks=w), f"T{i}", 0.1 * (i - 1.5), float(rng.normal(0, 0.03)), 4)
            for w in range(40) for i in range(4)]
    h = spark.createDataFrame(rows, "decision_session date, session date, ticker string, weight double, weekly_return double, n_names bigint")
    cov = {(r.ticker_i, r.ticker_j): r.covariance for r in shrunk_covariance(h).collect()}
    w = {f"T{i}": 0.1 * (i - 1.5) for i in range(4)}
    want = math.sqrt(sum(w[a] * w[b] * c for (a, b), c in cov.items())) * math.sqrt(52)
    assert portfolio_volatility(h).first()["book_vol"] == pytest.approx(want, rel=1e-9)


def test_limits_hold_on_random_books(spark):
    from tidemark.operators.book import Limits, apply_limits, check_limits

    rng = np.random.default_rng(4)
    rows = [(date(2024, 1, 1) + timedelta(days=b), f"T{i}", f"S{rng.integers(3)}", float(rng.normal(0, 0.2))) for b in range(25) for i in range(12)]
    df = spark.createDataFrame(rows, "decision_session date, ticker string, sector string, weight double")
    assert check_limits(apply_limits(df), Limits()).count() == 0


def test_distributions():
    from tidemark.functions.distributions import expected_max_sharpe, normal_cdf, t_two_sided

    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    assert expected_max_sharpe(1) == 0.0 and expected_max_sharpe(100) > 2.0


def test_no_overlap_and_registry(spark):
    from tidemark.operators.features.registry import REGISTRY, register
    from tidemark.operators.splits import verify_no_overlap, walk_forward_folds

    rows = [(date(2015, 1, 2) + timedelta(weeks=w), f"T{i}", date(2015, 1, 5) + timedelta(weeks=w), date(2015, 1, 5) + timedelta(weeks=w + 4), 0.0)
            for w in range(120) for i in range(3)]
    panel = spark.createDataFrame(rows, "decision_session date, ticker string, label_t0 date, label_t1 date, label double")
    folds = walk_forward_folds(panel, train_weeks=52, test_weeks=13, min_train_weeks=40, embargo_weeks=2)
    verify_no_overlap(folds, embargo_weeks=2)
    assert folds.filter("role = 'embargoed'").count() > 0
    with pytest.raises(ValueError):
        register("price", ("anything",))(lambda t: [])
    assert "patterns" in REGISTRY


def test_smoothing_steps_over_long_gaps(spark):
    from tidemark.functions.exprs import Trailing
    from tidemark.operators.features.smoothing import Smoother

    rng = np.random.default_rng(1)
    x = [float(rng.normal()) if not 20 <= i < 900 and i % 7 else None for i in range(1000)]
    df = spark.createDataFrame([("a", date(2000, 1, 1) + timedelta(days=i), v) for i, v in enumerate(x)], "ticker string, session date, x double")
    s = Smoother(Trailing(), {"y": ("x", 1 / 14, 3, False)})
    for level in [*s.levels(), s.values()]:
        df = df.withColumns(level)
    got = [r["_y"] for r in df.orderBy("session").select("_y").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=1 / 14, adjust=False, min_periods=3).mean()
    np.testing.assert_allclose([np.nan if v is None else v for v in got], want, rtol=1e-9)


def test_exact_copies_keep_one(spark):
    from tidemark.operators.dedupe import deduplicate

    at = datetime(2024, 1, 1)
    text = "a long enough body of text that repeats word for word in every copy of it"
    rows = [("h1", "T", "title", text, at), ("h1", "T", "title", text, at), ("h2", "T", "title", text, at), ("h3", "T", "other", "nothing of the kind here at all", at)]
    df = spark.createDataFrame(rows, "content_hash string, ticker string, title string, body string, available_at timestamp")
    assert sorted(r.content_hash for r in deduplicate(df).collect()) == ["h1", "h3"]


def test_bodies_are_compared_whole(spark):
    from tidemark.operators.dedupe import deduplicate, novelty_scores

    at, rng = datetime(2024, 1, 1), np.random.default_rng(0)
    tail = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400))
    head = "the same opening of a story " * 25
    rows = [("a", "T", "t", head + tail(), at), ("b", "T", "t", head + tail(), at + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "content_hash string, ticker string, title string, body string, available_at timestamp")
    assert deduplicate(df).count() == 2 and deduplicate(df, body_chars=600).count() == 1
    assert {r.content_hash: r.novelty for r in novelty_scores(df).collect()}["b"] > 0.8


def test_ledger_keeps_flat_weeks(spark):
    from tidemark.operators.performance import turnover, weekly_ledger

    week = [date(2024, 1, 5) + timedelta(weeks=i) for i in range(3)]
    books = spark.createDataFrame([(week[0], "A", 0.5), (week[2], "A", 0.25)], "decision_session date, ticker string, weight double")
    forward = spark.createDataFrame([(w, "A", 0.1) for w in week], "decision_session date, ticker string, forward_return double")
    costs = spark.createDataFrame([(w, 0.01, 0.2) for w in week], "decision_session date, total double, turnover double")
    got = {r.decision_session: r for r in weekly_ledger(books, forward, costs, weeks=forward).collect()}
    assert [round(got[w].net_return, 10) for w in week] == [0.04, -0.01, 0.015]
    assert all(abs(r.gross_return - r.cost - r.net_return) < 1e-12 for r in got.values()) and got[week[1]].n_positions == 0
    change = {r.decision_session: r.turnover for r in turnover(books, weeks=forward).collect()}
    assert [change[w] for w in week] == [0.25, 0.25, 0.125]


@pytest.mark.parametrize("method", ["window", "buckets"])
def test_ranks_take_nan_and_infinity_for_null(spark, method):
    from tidemark.functions.ranks import quantiles, rank_pct

    values = [1.5, 5.0, float("nan"), 2.0, None, float("inf"), -float("inf"), 2.0]
    df = spark.createDataFrame([("d", f"T{i}", v) for i, v in enumerate(values)], "d string, ticker string, v double")
    got = {r.ticker: r.v for r in rank_pct(df, ["d"], ["v"], keys=["ticker"], method=method).collect()}
    assert got == {"T0": 0.25, "T1": 1.0, "T2": None, "T3": 0.625, "T4": None, "T5": None, "T6": None, "T7": 0.625}
    q = quantiles(df, ["d"], "v", [0.0, 0.5, 1.0], method=method).first()
    assert (list(q.q), q.n) == ([1.5, 2.0, 5.0], 4)


def test_short_scenarios_and_folds_keep_a_row(spark):
    from tidemark.operators.models import walk_forward_predict, zero_score
    from tidemark.operators.performance import deflated_sharpe, sharpe_interval

    rows = [(s, date(2024, 1, 5) + timedelta(weeks=i), 0.01 * ((i * 7) % 5 - 2)) for s, n in (("long", 60), ("short", 5)) for i in range(n)]
    ledger = spark.createDataFrame(rows, "scenario string, decision_session date, net_return double")
    by = {r.scenario: r for r in sharpe_interval(ledger, draws=20).collect()}
    assert by["short"].sharpe_ci_low is None and by["long"].sharpe_ci_low is not None
    assert {r.scenario: r.verdict for r in deflated_sharpe(ledger, 1).collect()}["short"] == "too short"
    panel = spark.createDataFrame([(date(2024, 1, 5), "A", 0.1), (date(2024, 1, 12), "A", 0.2)], "decision_session date, ticker string, label double")
    folds = spark.createDataFrame([(0, "train", date(2024, 1, 5), "A"), (0, "test", date(2024, 1, 12), "A")], "fold int, role string, decision_session date, ticker string")
    out = walk_forward_predict(panel, folds, lambda train, fold: zero_score)
    assert [r.prediction for r in out.collect()] == [None]
    assert [r.prediction for r in walk_forward_predict(panel, folds, lambda train, fold: zero_score, min_labels=1).collect()] == [0.0]


def test_saved_model_is_refused_when_stale_or_different(spark, tmp_path):
    from tidemark.operators.evaluation import load_fitted, save_fitted
    from tidemark.operators.models import ridge

    rng = np.random.default_rng(5)
    rows = [(date(2024, 1, 5), f"T{i}", float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "decision_session date, ticker string, a double, b double, label double")
    fitted = ridge(df, ["a", "b"], alpha=1e-6)
    save_fitted(spark, fitted, str(tmp_path / "m"), date(2024, 1, 5))
    again = load_fitted(spark, str(tmp_path / "m"), ["b", "a"], date(2024, 2, 2))
    assert max(abs(r.prediction - r.label) for r in again.predict(df).collect()) < 1e-4
    with pytest.raises(ValueError, match="features differ"):
        load_fitted(spark, str(tmp_path / "m"), ["a"], date(2024, 2, 2))
    with pytest.raises(ValueError, match="weeks before"):
        load_fitted(spark, str(tmp_path / "m"), ["a", "b"], date(2024, 6, 2))


def test_verdict_rules(spark):
    from tidemark.operators.evaluation import verdicts

    rows = [("shuffled", -0.1, 0.02, 3.0), ("momentum", 0.9, 0.0, 0.0), ("random", 0.1, 0.0, 0.0), ("benchmark", 0.5, 0.0, 0.0), ("price_news", 0.6, 0.03, 3.4)]
    summary = spark.createDataFrame(rows, "scenario string, sharpe double, ic double, ic_t double")
    test = spark.createDataFrame([(0.2, 0.01)], "difference double, p_value double")
    assert {r.rule: r.holds for r in verdicts(summary, test).collect()} == {
        "no_leak": False, "beats_momentum": False, "random_is_poor": True, "news_adds": True, "beats_benchmark": True}
    assert {r.rule: r.holds for r in verdicts(summary.filter("scenario = 'random'")).collect()}["news_adds"] is None


def test_paths_of_a_perfect_and_a_useless_candidate(spark):
    from tidemark.operators.evaluation import path_scores, path_selections
    from tidemark.operators.performance import overfitting_probability

    rng = np.random.default_rng(9)
    rows = [(date(2020, 1, 3) + timedelta(weeks=w), f"T{i}", float(rng.normal())) for w in range(24) for i in range(15)]
    panel = spark.createDataFrame(rows, "decision_session date, ticker string, label double").cache()
    half = date(2020, 1, 3) + timedelta(weeks=16)
    folds = panel.select(F.lit(0).alias("fold"), F.when(F.col("decision_session") < F.lit(half), "train").otherwise("test").alias("role"), "decision_session", "ticker")
    right = lambda train: lambda df: df.withColumn("prediction", F.col("label"))
    wrong = lambda train: lambda df: df.withColumn("prediction", -F.col("label"))
    scores = path_scores(panel, folds, {"right": right, "wrong": wrong})
    got = {r.candidate: (r.in_sample, r.out_of_sample) for r in scores.collect()}
    assert got["right"] == pytest.approx((1, 1)) and got["wrong"] == pytest.approx((-1, -1))
    assert path_selections(scores).first().chosen == "right"
    assert overfitting_probability(scores).first().pbo == 0.0
