"""The normal probability far out, where a series of 220 terms cut at one half would not do."""

import math

from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_cdf_col


def test_normal_probability_far_out(spark):
    z = [-24.231654, -23.509162, -22.749512, -12.0, -9.0, -6.0, 6.0, 12.0, 24.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_cdf_col("z").alias("p")).collect()
    assert len(rows) == len(z)
    for r in rows:
        assert abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2.0))) < 1e-12, r
    assert {r.p for r in rows if r.z < -22} == {0.0}
