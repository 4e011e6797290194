"""Feature blocks: named sets of trailing columns that share one shuffle, one sort and a few window levels."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark import schemas as S
from tidemark.functions.sliding import Sliding

Level = dict[str, Column]
DEEP = 8


class After(dict):
    """A level that reads statistics of bounded frames. It holds no window of its own; scaffolding of earlier levels comes by ``value``."""


@dataclass(frozen=True)
class FeatureBlock:
    """``build(trailing)`` returns dictionaries of columns, each level reading only the levels before it.

    Names starting with an underscore are scaffolding and are dropped; the others must be exactly ``outputs``.
    """

    name: str
    outputs: tuple[str, ...]
    warmup_sessions: int
    build: Callable[[Sliding], list[Level]] = field(repr=False)


REGISTRY: dict[str, FeatureBlock] = {}


def register(name: str, outputs: tuple[str, ...], warmup_sessions: int = 0):
    """Add a function as a feature block; names must be new and outputs must not collide with another block."""

    def wrap(fn: Callable[[Sliding], list[Level]]):
        if name in REGISTRY:
            raise ValueError(f"feature block {name!r} exists")
        taken = {o for b in REGISTRY.values() for o in b.outputs} & set(outputs)
        if taken:
            raise ValueError(f"block {name!r} declares features that exist: {sorted(taken)}")
        REGISTRY[name] = FeatureBlock(name, tuple(outputs), warmup_sessions, fn)
        return fn

    return wrap


def select_blocks(names: list[str] | None = None) -> list[FeatureBlock]:
    unknown = set(names or []) - set(REGISTRY)
    if unknown:
        raise KeyError(f"unknown feature blocks {sorted(unknown)}; known: {sorted(REGISTRY)}")
    return [REGISTRY[n] for n in (names or REGISTRY)]


def apply_blocks(bars: DataFrame, blocks: list[FeatureBlock], sessions: DataFrame | None = None) -> DataFrame:
    """Keys, numbers of the bars and features of all blocks, of every bar or of those on ``sessions``.

    All blocks go over one window order; equal levels of different blocks become one window operator, and the statistics of bounded frames
    of all blocks one pass after them. Blocks of many levels go first and by themselves, while rows are still narrow: every level copies
    its rows. Rows are cut to the wanted sessions in the pass, which has seen the whole history.
    """
    trailing = Sliding()
    deep: list[Level] = []
    levels: list[Level] = []
    after: list[Level] = []
    for block in blocks:
        built = block.build(trailing)
        made = {n for level in built for n in level if not n.startswith("_")}
        if made != set(block.outputs):
            raise ValueError(f"{block.name} declares {sorted(set(block.outputs) ^ made)} inconsistently")
        before = [level for level in built if not isinstance(level, After)]
        if len(before) > DEEP:
            deep += before
            before = []
        for stage, of in ((levels, before), (after, [level for level in built if isinstance(level, After)])):
            for depth, level in enumerate(of):
                if depth == len(stage):
                    stage.append({})
                stage[depth].update(level)
    numbers = [f.name for f in bars.schema.fields if isinstance(f.dataType, NumericType)]
    keep = list(dict.fromkeys([S.TICKER, S.SESSION, *numbers]))
    # One row per session of the calendar, sent to the bars: by a shuffle on the session all daily rows would travel with all features.
    wanted = None if sessions is None else F.broadcast(sessions.select(S.SESSION).distinct().withColumn("_wanted", F.lit(True)))
    out = bars.select(*keep)
    if wanted is not None:
        out = out.join(wanted, S.SESSION, "left")
    for level in deep + levels:
        out = out.withColumns(level)
    features = [o for b in blocks for o in b.outputs]
    if trailing.asked:
        ready = [c for level in deep + levels for c in level if c in features]
        out = trailing.fill(out, [*keep, *ready], None if wanted is None else "_wanted")
    elif wanted is not None:
        out = out.where("_wanted")
    for level in after:
        out = out.withColumns(level)
    return out.select(*keep, *features)
