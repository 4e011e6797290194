"""From bars to the modelling panel: one row per (decision, ticker)."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators import cross_section as xs
from tidemark.operators import features, visibility
from tidemark.session import materialise


def raw_features(bars: DataFrame, *, sessions: DataFrame | None = None, asof: date | str | None = None,
                 blocks: tuple[str, ...] = features.ALL_BLOCKS) -> DataFrame:
    """Price features; with ``asof`` later rows are removed before any window can see them."""
    if asof is not None:
        bars = visibility.truncate_sessions(bars, asof)
    out = features.price_features(bars, sessions, blocks)
    return visibility.guard_output(out, asof) if asof is not None else out


def build_panel(bars: DataFrame, decisions: DataFrame, *, membership: DataFrame | None = None,
                labels: DataFrame | None = None, news: DataFrame | None = None, min_names: int = 20,
                normalize: bool = True, sector_neutral: bool = False, asof: date | str | None = None,
                blocks: tuple[str, ...] = features.ALL_BLOCKS, rank_method: str = "buckets", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Features on the decision rows, members only, with news and labels attached, then ranked within each date.

    Ranking comes last on purpose: it has to see exactly the names that can be held that day. ``wanted`` price features only: the others
    are neither computed nor ranked.
    """
    keys = [S.DECISION, S.TICKER]
    marks = decisions.select(F.col(S.DECISION).alias(S.SESSION))
    panel = raw_features(bars, sessions=marks, asof=asof, blocks=blocks).withColumnRenamed(S.SESSION, S.DECISION)
    if wanted is not None:
        panel = panel.select(*keys, *wanted)
    if membership is not None:
        panel = panel.join(membership.withColumnRenamed(S.SESSION, S.DECISION).select(*keys, S.SECTOR), keys)
    else:
        panel = panel.withColumn(S.SECTOR, F.lit("Unknown"))
    if news is not None:
        panel = panel.join(news, keys, "left")
    if labels is not None:
        panel = panel.join(labels, keys, "left")
    # read by the date counts, the ranks and the result: cut here, after the decision rows are chosen
    panel = xs.drop_thin_dates(materialise(panel.withColumn("_number", F.monotonically_increasing_id()), "panel"), min_names=min_names)
    if not normalize:
        return panel.drop("_number")
    columns = feature_columns(panel)
    panel = xs.cross_sectional_rank(panel, columns, min_names=min_names, method=rank_method, row="_number").drop("_number")
    return xs.sector_neutralize(panel, columns) if sector_neutral else panel


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in S.NOT_FEATURES and not c.startswith("_")]


def price_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in feature_columns(df) if not c.startswith(S.NEWS_PREFIX)]


def news_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in feature_columns(df) if c.startswith(S.NEWS_PREFIX)]
