"""The ordered near-duplicate pass in runs, and the search for similar stories by bits, against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dedupe

SCHEMA = "id long, ticker string, title string, body string, available_at timestamp"


def _texts(rng, n):
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(50)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            t = out[rng.integers(len(out))].split()
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = words[rng.integers(50)]
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choice(words, rng.integers(1, 60))))
    return out


def test_text_is_normalised_alike_in_python(spark):
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", " ", "　", "﻿",
             "A", "b", "(Reuters)", "(pti)", "- reuters", "click  here", "read", "more", "also read", "advertisement", "subscribe to", "(a(ani)ni)"]
    rows = [(None,), ("",)] + [("".join(rng.choice(parts, rng.integers(1, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").select(F.lower("t").alias("lower"), text.normalise_text("t").alias("want"))
    for r in df.collect():
        assert r.want == (None if r.lower is None else text.normalised(r.lower)), repr(r.lower)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_similar_texts_are_those_of_the_gram_sets(threshold):
    rng = np.random.default_rng(4)
    texts = _texts(rng, 120) + ["a", "ab", "abcd", "abcde", "abcdef", "x" * 400, "x" * 5, "一二三四五六" * 30, "一二三四五七" * 30]
    texts.append(" ".join(texts[:100]))
    texts.append(texts[-1] + " " + texts[100])
    sizes = np.array([len({t[i:i + 5] for i in range(len(t) - 4)} or {t}) for t in texts])
    i, j = dedupe._similar(texts, sizes, lambda a, others: np.ones(len(others), np.bool_), threshold)
    got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    near = np.argwhere(np.triu(dedupe._overlaps(texts) >= threshold, 1))
    assert len(i) == len(got) and got == {tuple(p) for p in near.tolist()}
    assert threshold == 1.0 or len(got) > 5


@pytest.mark.parametrize("weight", [1, 7, 40, 500_000])
def test_runs_keep_what_the_ordered_pass_keeps(spark, monkeypatch, weight):
    rng = np.random.default_rng(weight)
    rows = []
    for i, t in enumerate(_texts(rng, 150)):
        at = datetime(2024, 1, 1) + timedelta(hours=int(7 * i + rng.integers(0, 3) * 5))
        rows += [(int(rng.integers(1 << 60)), "A" if i % 4 else "B", t, "", at)] * (2 if i % 9 == 0 else 1)
    grams = [{t[i:i + 5] for i in range(len(t) - 4)} or {t} for t in (r[2] for r in rows)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    kept = []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][4], rows[k][0])):
        if not any(rows[o][1] == rows[k][1] and rows[k][4] - rows[o][4] <= timedelta(hours=72) and jaccard(grams[k], grams[o]) >= 0.6 for o in kept):
            kept.append(k)
    monkeypatch.setattr(dedupe, "RUN_WEIGHT", weight)
    got = dedupe.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), id_col="id").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows[k] for k in kept)
    assert 20 < len(kept) < len(rows) - 20


def test_unbroken_coverage_does_not_take_a_round_for_each_kept_article(spark, monkeypatch):
    """A text that comes back every forty hours: every second one is kept, which once left 129 tables."""
    rows = [(i, "A", "the same words come back again and again", "", datetime(2024, 1, 1) + timedelta(hours=40 * i)) for i in range(120)]
    tables, store = [], dedupe.materialise
    monkeypatch.setattr(dedupe, "materialise", lambda df, name="stage": tables.append(name) or store(df, name))
    got = dedupe.deduplicate(spark.createDataFrame(rows, SCHEMA), id_col="id").collect()
    assert sorted(r.id for r in got) == list(range(0, 120, 2))
    assert len(tables) < 12


def test_copies_without_an_instant_a_text_or_a_ticker_stay(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "A", "some words", "", None), (2, "A", "some words", "", None), (3, "A", "some words", "", at), (4, "A", "some words", "", at),
            (5, None, "some words", "", at), (6, None, "some words", "", at), (7, "A", None, "", at), (8, "A", None, "", at), (9, "A", "", "", at),
            (10, "A", "", "", at), (None, "A", "other text", "", at), (12, "A", "other text", "", at), (1 << 60, "A", "third", "", at), ((1 << 60) + 1, "A", "third", "", at)]
    got = {r.id for r in dedupe.deduplicate(spark.createDataFrame(rows, SCHEMA), id_col="id").collect()}
    assert got == {1, 2, 3, 5, 6, 7, 8, 9, 10, None, 1 << 60}
