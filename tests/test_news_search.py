"""Novelty and the ordered pass against brute force on coverage of every kind."""

from datetime import datetime, timedelta

import numpy as np
import pytest


def _grams(text):
    return {text[i:i + 5] for i in range(len(text) - 4)} or ({text} if text else set())


def _coverage(spark, kind):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    words = [word() for _ in range(60)]
    rows, texts = [], []
    for i in range(90):
        if kind == "copies" and texts and rng.random() < 0.7:
            t = texts[-1] if rng.random() < 0.6 else texts[rng.integers(len(texts))]
        elif kind != "short" and texts and rng.random() < 0.5:
            t = texts[rng.integers(len(texts))].split()
            t[rng.integers(len(t))] = words[rng.integers(60)]
            t = " ".join(t)
        else:
            t = " ".join(rng.choice(words, 9)) if kind != "short" else word()[: rng.integers(0, 6)]
        texts.append(t)
        ticker = "A" if kind == "hot" or i % 3 else "B"
        rows.append((f"h{i // 2 if kind == 'copies' else i}", ticker, t, "", datetime(2024, 1, 1) + timedelta(hours=int(5 * i + rng.integers(4)))))
    return rows, spark.createDataFrame(rows, "content_hash string, ticker string, title string, body string, available_at timestamp").repartition(3)


@pytest.mark.parametrize("kind", ["mixed", "copies", "hot", "short"])
def test_novelty_and_greedy_pass_equal_brute_force(spark, kind):
    from collections import Counter

    from tidemark.operators.dedupe import deduplicate, novelty_scores

    rows, df = _coverage(spark, kind)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    norm = lambda r: _grams(" ".join((r[2] + " ").lower().split()))
    want = Counter()
    for r in rows:
        before = [norm(o) for o in rows if o[1] == r[1] and (o[4], o[0]) < (r[4], r[0]) and r[4] - o[4] <= timedelta(days=7)]
        want[(r[0], r[1], r[4], round(1.0 - max((jaccard(norm(r), g) for g in before), default=0.0), 9))] += 1
    got = Counter((r.content_hash, r.ticker, r.available_at, round(r.novelty, 9)) for r in novelty_scores(df).collect())
    assert got == want
    kept = []
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        if not any(k[1] == r[1] and r[4] - k[4] <= timedelta(hours=72) and jaccard(norm(r), norm(k)) >= 0.6 for k in kept):
            kept.append(r)
    assert Counter((r.content_hash, r.ticker, r.available_at) for r in deduplicate(df).collect()) == Counter((r[0], r[1], r[4]) for r in kept)


def test_batch_analyzer_matches_answers_by_key(spark):
    from tidemark.operators.analysis import with_batch_analyzer

    df = spark.createDataFrame([(k, f"T{k}") for k in ("a", "b", "c", "d", "d")], "content_hash string, ticker string").coalesce(1)

    def answers(batch):
        import pandas as pd

        return pd.DataFrame({"content_hash": ["x", "d", "b", "a", "b"], "sentiment": [9.0, 4.0, 2.0, 1.0, 7.0], "event_type": ["e"] * 5})

    got = {(r.content_hash, r.ticker, r.sentiment, r.status) for r in with_batch_analyzer(df, answers, ["sentiment", "event_type"]).collect()}
    assert got == {("a", "Ta", 1.0, "ok"), ("b", "Tb", 2.0, "repeated"), ("c", "Tc", None, "missing"), ("d", "Td", 4.0, "ok"), ("x", None, 9.0, "unasked")}

    def broken(batch):
        raise RuntimeError("no service")

    assert {(r.status, r.error, r.sentiment) for r in with_batch_analyzer(df, broken, ["sentiment"]).collect()} == {("failed", "RuntimeError: no service", None)}
    assert with_batch_analyzer(df.limit(0), answers, ["sentiment"]).count() == 0


def test_streamed_table_has_one_state_at_a_time(spark, tmp_path):
    from datetime import date

    from tidemark.streaming.ingest import _names, _newest, read_bars, upsert_bars

    schema, target = "ticker string, session date, close double", str(tmp_path / "bars")
    batch = lambda rows: spark.createDataFrame(rows, schema)
    write = upsert_bars(spark, target)
    write(batch([("A", date(2020, 1, 1), 1.0), ("A", date(2021, 1, 1), 2.0)]), 0)
    before = read_bars(spark, target)
    write(batch([("A", date(2021, 1, 1), 3.0), ("B", date(2022, 1, 1), 4.0)]), 1)
    assert sorted(tuple(r)[2] for r in before.select("ticker", "session", "close").collect()) == [1.0, 2.0]  # a reader under way keeps its state
    state = lambda: sorted((r.ticker, r.session.year, r.close) for r in read_bars(spark, target).collect())
    assert state() == [("A", 2020, 1.0), ("A", 2021, 3.0), ("B", 2022, 4.0)]
    version, _ = _newest(spark, target)
    write(batch([("A", date(2021, 1, 1), 9.0)]), 1)  # the same batch again
    assert _newest(spark, target)[0] == version and state()[1] == ("A", 2021, 3.0)
    for i in range(2, 7):
        write(batch([("A", date(2021, 1, 1), float(i))]), i)
    assert state() == [("A", 2020, 1.0), ("A", 2021, 6.0), ("B", 2022, 4.0)]
    assert len([n for n in _names(spark, f"{target}/_manifests") if n.isdigit()]) == 2 and len([n for n in _names(spark, target) if n.startswith("v=")]) <= 4
    write(batch([]), 9)
    assert len(state()) == 3
