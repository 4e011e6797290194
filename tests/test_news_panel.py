"""The news panel: no price column is ranked, the articles are aggregated once."""

import re

from pyspark.sql import functions as F

from tidemark.operators import calendar as cal
from tidemark.operators import news_features
from tidemark.plans.catalog import load
from tidemark.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_news_panel_ranks_no_price_features_and_aggregates_news_once(spark):
    made = load().QUERIES["x6_panel_with_news"](spark, SF)
    assert not re.search("mom_12w|vol_13w|reversal_1w", made._jdf.queryExecution().analyzed().toString())
    an, grid = fx.analyses(spark, SF), cal.all_decisions(fx.event_sessions(spark, SF).withColumn("position", F.lit(0)))
    assert "sentiment_decay" in news_features.build_news_features(an, grid).columns[2]
    assert "Generate explode" not in news_features.build_news_features(an, grid)._jdf.queryExecution().executedPlan().toString()
