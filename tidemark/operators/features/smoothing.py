"""Exponentially smoothed features, without leaving the window operators.

``y[t] = (1 - a) y[t-1] + a x[t]`` is a linear recurrence, so it can be summed by doubling: after ``j`` steps a row
holds the contribution of its last ``2**j`` inputs, and one ``lag`` by ``2**j`` rows doubles that. Nine or so steps
reach the point where older inputs weigh less than a rounding error. All series of a level share one window operator,
and every level keeps the shuffle and sort of the other trailing features. (The closed form with ``(1-a)**-t`` would
overflow, and a loop over the rows of a ticker would push all daily rows out of the JVM.)
"""

import math

from pyspark.sql import functions as F

from tidemark.functions.exprs import Trailing, div
from tidemark.operators.features.registry import Level, register

OUTPUTS = ("ema_slope_20", "macd_norm", "macd_hist_norm", "rsi_14", "rsi_14_centered", "atr_pct_14", "adx_14",
           "di_spread_14")


def _steps(alpha: float) -> int:
    """Doublings until the left-out inputs weigh less than one unit in the last place."""
    return math.ceil(math.log2(math.log(1e-16) / math.log(1.0 - alpha)))


class Smoother:
    """Several smoothed series built together: ``levels()`` lists the columns of each window level.

    ``series`` maps a name to (input column, alpha, least count, gapless). The result is column ``_<name>``, null until
    ``least`` inputs were seen. A gap keeps the last value while the weight of the past fades, so a series that may
    have gaps carries its coefficient along as a second column and steps from value to value, however long the gap.
    """

    def __init__(self, t: Trailing, series: dict[str, tuple[str, float, int, bool]]):
        self.t, self.series = t, series

    def levels(self) -> list[Level]:
        t = self.t
        seen = {f"_{n}_k": t.running(F.count, x) for n, (x, *_rest) in self.series.items()}
        gaps = {f"_{n}_at": t.running(F.max, F.when(F.col(x).isNotNull(), F.col("_row")))
                for n, (x, _, _, gapless) in self.series.items() if not gapless}
        out: list[Level] = [{"_row": t.row()}, seen | gaps]
        first: Level = {}
        for n, (x, alpha, _, gapless) in self.series.items():
            x, k = F.col(x), F.col(f"_{n}_k")
            if gapless:
                first[f"_{n}_b0"] = F.coalesce(F.when(k == 1, x).otherwise(alpha * x), F.lit(0.0))
                continue
            waited = F.col("_row") - t.lag(f"_{n}_at")
            past = F.pow(F.lit(1.0 - alpha), waited)
            starts = x.isNotNull() & (k == 1)
            first[f"_{n}_a0"] = F.when(x.isNotNull(), F.when(starts, 0.0).otherwise(past / (past + alpha)))
            first[f"_{n}_b0"] = F.when(x.isNotNull(), F.when(starts, x).otherwise(alpha * x / (past + alpha)))
        out.append(first)
        for j in range(max(_steps(a) for _, a, _, _ in self.series.values())):
            level: Level = {}
            for n, (_, alpha, _, gapless) in self.series.items():
                if j >= _steps(alpha):
                    continue
                lag = t.lag if gapless else t.lag_known  # over a gap, steps count values and not rows
                back = F.coalesce(lag(f"_{n}_b{j}", 2**j), F.lit(0.0))
                factor = F.lit((1.0 - alpha) ** (2**j)) if gapless else F.col(f"_{n}_a{j}")
                level[f"_{n}_b{j + 1}"] = F.col(f"_{n}_b{j}") + factor * back
                if not gapless:
                    level[f"_{n}_a{j + 1}"] = factor * F.coalesce(lag(f"_{n}_a{j}", 2**j), F.lit(0.0))
            out.append(level)
        return out

    def values(self) -> Level:
        last = lambda c: self.t.running(lambda x: F.last(x, ignorenulls=True), c)
        end = {n: f"_{n}_b{_steps(a)}" for n, (_, a, _, _) in self.series.items()}
        return {
            f"_{n}": F.when(F.col(f"_{n}_k") >= least, F.col(end[n]) if gapless else last(end[n]))
            for n, (_, _, least, gapless) in self.series.items()
        }


def _span(n: int) -> float:
    return 2.0 / (n + 1)


@register("smoothing", OUTPUTS, 220)
def smoothing(t: Trailing):
    c = F.col
    change = c("close") - t.lag("close")
    up, down = c("high") - t.lag("high"), t.lag("low") - c("low")
    # Three-way greatest skips the nulls of the first row.
    spread = F.greatest(c("high") - c("low"), F.abs(c("high") - t.lag("close")), F.abs(c("low") - t.lag("close")))
    inputs = {
        "_gain": F.when(change > 0, change).when(change.isNotNull(), 0.0),
        "_loss": F.when(change < 0, -change).when(change.isNotNull(), 0.0),
        "_tr": spread,
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }
    wilder = 1.0 / 14
    one = Smoother(t, {
        "e20": ("close", _span(20), 20, True), "e12": ("close", _span(12), 12, True), "e26": ("close", _span(26), 26, True),
        "wg": ("_gain", wilder, 14, True), "wl": ("_loss", wilder, 14, True), "wt": ("_tr", wilder, 14, False),
        "wp": ("_pdm", wilder, 14, True), "wm": ("_mdm", wilder, 14, True),
    })
    rsi = F.when(c("_wl") > 0, 100.0 - 100.0 / (1.0 + div("_wg", "_wl"))).otherwise(
        F.when(c("_wg") > 0, 100.0).otherwise(0.0))  # 0 before the warm-up is over
    plus, minus = 100.0 * div("_wp", "_wt"), 100.0 * div("_wm", "_wt")
    derived = {
        "_macd": c("_e12") - c("_e26"), "rsi_14": rsi, "atr_pct_14": div("_wt", "close"),
        "ema_slope_20": div(c("_e20") - t.lag("_e20", 10), "close"),
        "_dx": div(100.0 * F.abs(plus - minus), plus + minus), "di_spread_14": (plus - minus) / 100.0,
    }
    two = Smoother(t, {"sig": ("_macd", _span(9), 9, True), "adx": ("_dx", wilder, 14, False)})
    return [
        inputs, *one.levels(), one.values(), derived, *two.levels(), two.values(),
        {"macd_norm": div("_macd", "close"), "macd_hist_norm": div(c("_macd") - c("_sig"), "close"),
         "adx_14": c("_adx"), "rsi_14_centered": (c("rsi_14") - 50.0) / 50.0},
    ]
