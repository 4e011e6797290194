"""Column helpers: null-safe arithmetic and trailing-window statistics."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(x, y) -> Column:
    """``x / y`` with a null result where ``y`` is zero (ANSI mode would raise)."""
    return col(x) / F.nullif(col(y), F.lit(0.0))


def finite(c) -> Column:
    """NaN and infinities as null: Spark orders NaN as the largest value, which no statistic here wants."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ln_pos(c) -> Column:
    c = col(c)
    return F.when(c > 0, F.ln(c))


def clip(c, low=None, high=None) -> Column:
    """Clamp to a range, keeping null (``greatest``/``least`` would skip it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def indicator(cond: Column) -> Column:
    """1.0 / 0.0, null where the condition is null."""
    return F.when(cond, 1.0).when(~cond, 0.0)


class Trailing:
    """Statistics over the rows before and at each row of one series.

    Every method uses the same partitioning and ordering, so a whole feature build needs one shuffle and one sort.
    ``at_least`` is the number of non-null values below which the result is null. ``shift`` moves the frame back
    without a second window level.
    """

    def __init__(self, by="ticker", order="session"):
        by, order = ([x] if isinstance(x, str) else list(x) for x in (by, order))
        self.window = Window.partitionBy(*by).orderBy(*order)
        self.sql = f"partition by {', '.join(f'`{c}`' for c in by)} order by {', '.join(f'`{c}`' for c in order)}"

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.window)

    def lag_known(self, name: str, n: int = 1) -> Column:
        """The ``n``-th non-null value before a row."""
        return F.expr(f"lag(`{name}`, {n}) ignore nulls over ({self.sql})")

    def frame(self, rows: int, shift: int = 0):
        return self.window.rowsBetween(-(rows - 1) - shift, -shift)

    def stat(self, fn, c, rows: int, at_least: int | None = None, shift: int = 0) -> Column:
        frame = self.frame(rows, shift)
        enough = F.count(col(c)).over(frame) >= (rows if at_least is None else at_least)
        return F.when(enough, fn(col(c)).over(frame))

    def mean(self, c, rows, at_least=None, shift=0):
        return self.stat(F.avg, c, rows, at_least, shift)

    def std(self, c, rows, at_least=None, shift=0):
        return self.stat(F.stddev_samp, c, rows, at_least, shift)

    def max(self, c, rows, at_least=None, shift=0):
        return self.stat(F.max, c, rows, at_least, shift)

    def min(self, c, rows, at_least=None, shift=0):
        return self.stat(F.min, c, rows, at_least, shift)

    def sum(self, c, rows, at_least=None, shift=0):
        return self.stat(F.sum, c, rows, at_least, shift)

    def power_sums(self, name: str, c, rows: int, order: int = 2, shift: int = 0) -> dict[str, Column]:
        """Count and sums of powers over one frame, as columns ``_<name>_n``, ``_<name>_s1`` ...

        Moments are formed from these columns one level later: written as one expression, every mention of a sum would
        become a window function of its own.
        """
        x, frame = col(c), self.frame(rows, shift)
        out, power = {f"_{name}_n": F.count(x).over(frame).cast("double")}, F.lit(1.0)
        for k in range(1, order + 1):
            power = power * x
            out[f"_{name}_s{k}"] = F.sum(power).over(frame)
        return out

    def running(self, fn, c) -> Column:
        return fn(col(c)).over(self.window.rowsBetween(Window.unboundedPreceding, 0))

    def row(self) -> Column:
        return F.row_number().over(self.window)


class Moments:
    """Moments from the columns of ``Trailing.power_sums``.

    For series centred near zero (returns) or of moderate size, sums of powers lose nothing that matters. A second
    moment that is rounding noise counts as zero. Results are null below ``at_least`` values.
    """

    def __init__(self, name: str, at_least: int):
        self.enough = F.col(f"_{name}_n") >= at_least
        self.n = F.nullif(F.col(f"_{name}_n"), F.lit(0.0))
        self.raw = lambda k: F.col(f"_{name}_s{k}") / self.n
        self.mean = self.raw(1)
        second = self.raw(2) - self.mean * self.mean
        self.m2 = F.when(second > self.raw(2) * 1e-13, second).when(second.isNotNull(), 0.0)

    def std(self) -> Column:
        return F.when(self.enough & (self.n > 1), F.sqrt(self.m2 * self.n / F.nullif(self.n - 1, F.lit(0.0))))

    def skew(self) -> Column:
        """Bias-corrected skewness."""
        n, m = self.n, self.mean
        m3 = self.raw(3) - 3 * m * self.raw(2) + 2 * m * m * m
        value = m3 / F.pow(self.m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
        return F.when(self.enough & (n > 2) & (self.m2 > 0), value)

    def kurt(self) -> Column:
        """Bias-corrected excess kurtosis."""
        n, m = self.n, self.mean
        m4 = self.raw(4) - 4 * m * self.raw(3) + 6 * m * m * self.raw(2) - 3 * m * m * m * m
        excess = m4 / F.nullif(self.m2 * self.m2, F.lit(0.0)) - 3.0
        value = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * excess + 6.0)
        return F.when(self.enough & (n > 3), value)
