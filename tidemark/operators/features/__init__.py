"""All price features of daily bars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.features import market, smoothing, windows  # noqa: F401  (windows registers its blocks)
from tidemark.operators.features.registry import REGISTRY, apply_blocks, register, select_blocks

__all__ = ["FEATURES", "REGISTRY", "price_features", "register", "warmup_sessions"]

WINDOW_BLOCKS = ("price", "moments", "technical", "patterns", "smoothing")
MARKET = "regime"
ALL_BLOCKS = (*WINDOW_BLOCKS, MARKET)


def outputs(blocks: tuple[str, ...] = ALL_BLOCKS) -> tuple[str, ...]:
    return tuple(o for b in blocks for o in (market.OUTPUTS if b == MARKET else REGISTRY[b].outputs))


FEATURES = outputs()


def warmup_sessions(blocks: tuple[str, ...] = ALL_BLOCKS) -> int:
    return max(market.WARMUP_SESSIONS if b == MARKET else REGISTRY[b].warmup_sessions for b in blocks)


def price_features(bars: DataFrame, sessions: DataFrame | None = None,
                   blocks: tuple[str, ...] = ALL_BLOCKS) -> DataFrame:
    """Features of every bar, or only of the bars on ``sessions``.

    Windows always see the full history; rows are cut to the wanted sessions before anything is joined, so the joins
    carry the decision rows and not the daily ones.
    """
    keys = [S.TICKER, S.SESSION]
    clash = [o for o in outputs(blocks) if outputs(blocks).count(o) > 1]
    if clash:
        raise ValueError(f"blocks declare a feature twice: {sorted(set(clash))}")
    own = select_blocks([b for b in blocks if b != MARKET]) if set(blocks) != {MARKET} else []
    out = apply_blocks(bars, own, sessions).select(*keys, *[o for b in own for o in b.outputs])
    if MARKET in blocks:
        out = out.join(F.broadcast(market.market_features(bars)), S.SESSION, "left")
    return out.select(*keys, *outputs(blocks))
