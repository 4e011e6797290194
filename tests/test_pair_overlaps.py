"""Overlaps of texts that meet, against the n-grams as arrays."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.catalog.registry import QUERIES


def test_overlaps_are_those_of_the_gram_sets(spark):
    pick = random.Random(5)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 9000)]  # more characters than five of which fit one number
    kinds = ["ab", "abcdefgh é", ["\U0001F600", "\U0001F601", "x"], wide]
    rows = [("", "abc"), ("abc", ""), (None, "abc"), ("abc", "abc"), ("abc", "abcd"), ("abcde", "abcde"), ("abcdefgh", "abcdefgh"), ("aaaaa", "aaaaaaaaa")]
    for _ in range(60):
        of = pick.choice(kinds)
        x = "".join(pick.choice(of) for _ in range(pick.choice([1, 4, 5, 6, 50, 9000])))
        rows.append((x, x[len(x) // 3:] + "".join(pick.choice(of) for _ in range(pick.choice([0, 3, 20])))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a string, b string")
    got = {r.k: r.overlap for r in text.pair_overlaps(df, "a", "b").collect()}
    want = df.select("k", F.when((F.length("a") > 0) & (F.length("b") > 0), text.jaccard(text.char_ngrams("a"), text.char_ngrams("b"))).alias("v")).collect()
    assert got == {r.k: r.v for r in want}


def test_neighbours_meet_as_texts(spark):
    from tidemark.plans.catalog import load

    load()
    plan = QUERIES["n3_jaccard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan  # no arrays of n-grams are shuffled
