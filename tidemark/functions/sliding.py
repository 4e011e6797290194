"""Trailing statistics of bounded frames in one pass over sorted rows.

Spark's windows go through the whole frame again for each row, every aggregate by itself: a year of daily rows costs hundreds of updates
a row. Here the sorted rows of whole series leave Spark in Arrow batches once, and all statistics are made on arrays, frame position by
frame position, in the order in which Spark adds: sums and deviations are the same to the last bit.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import Trailing, col

KINDS = {F.avg: "avg", F.sum: "sum1", F.max: "max", F.min: "min", F.stddev_samp: "std"}


class Sliding(Trailing):
    """As ``Trailing``, with statistics of bounded frames as columns that ``fill`` makes.

    What is counted may hold lags and running totals, but no such statistic; ``shift`` takes the place of a lag of one.
    """

    def __init__(self, by="ticker", order="session"):
        super().__init__(by, order)
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.asked: dict[tuple, str] = {}
        self.passed: list[str] = []

    def _input(self, c) -> str:
        return self.inputs.setdefault(str(col(c)), (f"_in{len(self.inputs)}", col(c)))[0]

    def _ask(self, kind: str, c, rows: int, shift: int = 0, *more) -> Column:
        return F.col(self.asked.setdefault((kind, self._input(c), rows, shift, *more), f"_w{len(self.asked)}"))

    def value(self, c) -> Column:
        """A scaffolding column of a level before, for a level after ``fill``."""
        name = self._input(c)
        self.passed = list(dict.fromkeys([*self.passed, name]))
        return F.col(name)

    def stat(self, fn, c, rows, at_least=None, shift=0):
        enough = self._ask("count", c, rows, shift) >= (rows if at_least is None else at_least)
        return F.when(enough, self._ask(KINDS[fn], c, rows, shift))

    def power_sums(self, name, c, rows, order=2, shift=0):
        return {f"_{name}_n": self._ask("count", c, rows, shift)} | {f"_{name}_s{k}": self._ask(f"sum{k}", c, rows, shift) for k in range(1, order + 1)}

    def since_high(self, c, rows: int, at_least: int, share: float) -> Column:
        """Rows since the value was last at ``share`` of its trailing maximum or above; null if it never was."""
        return self._ask("since", c, rows, 0, at_least, share)

    def fill(self, df: DataFrame, keep: list[str], wanted: str | None = None) -> DataFrame:
        """``keep``, the passed values and all statistics asked for; of every row, or of those where the column ``wanted`` is true.

        A task holds one series at a time, as a window does.
        """
        asked, passed, row = dict(self.asked), list(self.passed), "_place"
        given = df.select(*keep, *[c.cast("double").alias(n) for n, c in self.inputs.values()], self.row().alias(row),
                          *([F.coalesce(F.col(wanted), F.lit(False)).alias("_wanted")] if wanted else ()))
        schema = T.StructType([*given.select(*keep, *passed).schema.fields, *[T.StructField(n, T.DoubleType()) for n in asked.values()]])
        names, some = schema.names, wanted is not None

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                first = np.flatnonzero(batch.column(row).to_numpy() == 1)
                cut = first[-1] if len(first) else 0
                if cut or (held and len(first)):
                    yield _filled([*held, batch.slice(0, cut)], asked, names, row, some)
                    held = []
                held.append(batch.slice(cut))
            if held:
                yield _filled(held, asked, names, row, some)

        return given.mapInArrow(run, schema)


def _filled(batches: list[pa.RecordBatch], asked: dict[tuple, str], names: list[str], row: str, some: bool) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    place = table.column(row).to_numpy()
    series = np.cumsum(place == 1) - 1
    pads: dict[tuple, tuple] = {}
    made = {}
    for (kind, name, rows, shift, *more), out in asked.items():
        reach = rows - 1 + shift
        at = np.arange(len(place)) + series * reach
        if (name, reach) not in pads:
            pads[name, reach] = _padded(table.column(name), at + reach, reach)
        x, known = pads[name, reach]
        value, null = _stat(kind, x, known, rows, len(x) - reach)
        value, null = value[at], null if null is None else null[at]
        if kind == "since":
            value, null = _since(value, *_plain(table.column(name)), place, *more, _stat("count", x, known, rows, len(x) - reach)[0][at])
        made[out] = pa.array(value, pa.float64(), mask=null)
    filled = pa.table([made[n] if n in made else table.column(n) for n in names], names=names)
    if some:
        filled = filled.filter(table.column("_wanted"))
    filled = filled.combine_chunks()
    return filled.to_batches()[0] if filled.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in filled.schema], schema=filled.schema)


def _plain(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where there is none, and which there are."""
    known = column.is_valid().to_numpy().astype(bool)
    return column.fill_null(0.0).to_numpy().astype(float), known


def _padded(column: pa.ChunkedArray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The values with ``reach`` empty places before each series, so that no frame reaches into another one."""
    plain, valid = _plain(column)
    size = int(at[-1]) + 1 if len(at) else reach
    x, known = np.zeros(size), np.zeros(size, bool)
    x[at], known[at] = plain, valid
    return x, known


def _stat(kind: str, x: np.ndarray, known: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The statistic of ``x[i:i + rows]`` for each ``i`` below ``size``, and where it is null; without values only counts and sums mean anything."""
    if kind == "count":
        total = np.concatenate([[0], np.cumsum(known)])
        return (total[rows:rows + size] - total[:size]).astype(float), None
    if kind in ("max", "min", "since"):
        op, empty = (np.fmin, np.nan) if kind == "min" else (np.maximum, -np.inf)  # Spark orders NaN as the largest value
        out, have = np.where(known, x, empty), 1
        while 2 * have <= rows:
            out, have = op(out[:-have], out[have:]) if len(out) > have else out[:0], 2 * have
        if have < rows:
            out = op(out[:len(out) - (rows - have)], out[rows - have:])
        return out[:size], None
    if kind == "std":
        n, mean, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
        for j in range(rows):
            v, one = x[j:j + size], known[j:j + size]
            more, delta = n + 1.0, v - mean
            step = delta / more
            m2 = np.where(one, m2 + delta * (delta - step), m2)
            n, mean = np.where(one, more, n), np.where(one, mean + step, mean)
        return np.sqrt(m2 / np.where(n > 1, n - 1.0, 1.0)), n < 2
    power = x
    for _ in range(int(kind[3:]) - 1 if kind != "avg" else 0):
        power = power * x
    total = np.zeros(size)
    for j in range(rows):
        total += power[j:j + size]
    if kind == "avg":
        total /= np.maximum(_stat("count", x, known, rows, size)[0], 1.0)
    return total, None


def _since(high: np.ndarray, x: np.ndarray, known: np.ndarray, place: np.ndarray, at_least: int, share: float, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    here = known & (count >= at_least) & ((x >= high * share) | np.isnan(x))
    index = np.arange(len(x))
    last = np.maximum.accumulate(np.where(here, index, -1))
    never = last < index - (place - 1)
    return (index - last).astype(float), never
