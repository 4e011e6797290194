"""SQL for the price features, written as ordinary windows over the bars."""


def _w(rows: int, shift: int = 0) -> str:
    end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
    return f"(PARTITION BY ticker ORDER BY session ROWS BETWEEN {rows - 1 + shift} PRECEDING AND {end})"


def r(fn: str, c: str, rows: int, least: int, shift: int = 0) -> str:
    w = _w(rows, shift)
    return f"CASE WHEN count({c}) OVER {w} >= {least} THEN {fn}({c}) OVER {w} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY session)"


def div(x: str, y: str) -> str:
    return f"(({x}) / nullif({y}, 0))"


def _moment(kind: str) -> str:
    """Sample skewness / excess kurtosis of the 65-row window from its central moments."""
    w = _w(65)
    fn = {"skew": "skewness", "kurt": "kurtosis"}[kind]
    return f'CASE WHEN count(ret) OVER {w} >= 40 THEN {fn}(ret) OVER {w} END'


LEVEL_0 = f"""
f0 AS (SELECT *, CASE WHEN "close" > 0 THEN ln("close") END AS lc, {lag('"close"')} AS pc,
              ln(1 + greatest(volume, 0)) AS logv, (high + low + "close") / 3.0 AS typical FROM bars)"""

LEVEL_1 = f"""
f1 AS (SELECT *, lc - {lag('lc')} AS ret, {lag('high')} AS ph, {lag('low')} AS pl, typical - {lag('typical')} AS dtyp,
  {r('max', 'high', 20, 15)} AS h20, {r('min', 'low', 20, 15)} AS l20,
  {r('max', 'high', 60, 40)} AS h60, {r('min', 'low', 60, 40)} AS l60,
  {r('max', '"close"', 252, 120)} AS c252, {r('min', '"close"', 252, 120)} AS m252,
  {r('max', 'high', 5, 3)} AS h5, {r('min', 'low', 5, 3)} AS l5,
  {r('max', 'high', 14, 10)} AS h14, {r('min', 'low', 14, 10)} AS l14,
  {r('avg', '"close"', 10, 8)} AS s10, {r('avg', '"close"', 20, 15)} AS s20, {r('avg', '"close"', 50, 35)} AS s50,
  {r('avg', '"close"', 200, 140)} AS s200, {r('stddev_samp', '"close"', 20, 15)} AS d20,
  {r('avg', 'volume', 20, 15)} AS v20, {r('avg', 'logv', 65, 40, 1)} AS lvm, {r('stddev_samp', 'logv', 65, 40, 1)} AS lvs,
  {r('max', '"close"', 20, 15)} AS cx20,
  row_number() OVER (PARTITION BY ticker ORDER BY session) AS rn,
  sum(coalesce(sign("close" - pc), 0) * volume) OVER (PARTITION BY ticker ORDER BY session) AS obv FROM f0)"""

LEVEL_2 = f"""
f2 AS (SELECT *, CASE WHEN ret < 0 THEN ret ELSE 0 END AS down,
  CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END AS up,
  CASE WHEN dtyp > 0 THEN typical * volume ELSE 0 END AS pos, CASE WHEN dtyp < 0 THEN typical * volume ELSE 0 END AS neg,
  CASE WHEN ph IS NOT NULL THEN CASE WHEN high <= ph AND low >= pl THEN 1.0 ELSE 0.0 END END AS inside,
  {div('abs("close" - open)', 'high - low')} AS body,
  CASE WHEN "close" >= c252 * 0.999::DOUBLE THEN rn END AS hit, {div('open - pc', 'pc')} AS gap FROM f1)"""

LEVEL_3 = f"""
f3 AS (SELECT *, {r('stddev_samp', 'ret', 65, 40)} * sqrt(252.0) AS vol_13w,
  {r('stddev_samp', 'ret', 130, 80)} * sqrt(252.0) AS vol_26w,
  {div('"close"', lag('h20'))} - 1 AS breakout_20d,
  CASE WHEN {lag('h60', 60)} IS NOT NULL THEN CASE WHEN h60 > {lag('h60', 60)} THEN 1.0 ELSE 0.0 END END AS hh,
  CASE WHEN {lag('l60', 60)} IS NOT NULL THEN CASE WHEN l60 > {lag('l60', 60)} THEN 1.0 ELSE 0.0 END END AS hl FROM f2)"""

COLUMNS = {
    "mom_4w": f"lc - {lag('lc', 20)}", "mom_12w": f"lc - {lag('lc', 60)}", "mom_26w": f"lc - {lag('lc', 130)}",
    "mom_52w_skip4w": f"(lc - {lag('lc', 252)}) - (lc - {lag('lc', 20)})",
    "reversal_1w": f"-(lc - {lag('lc', 5)})", "reversal_2w": f"-(lc - {lag('lc', 10)})",
    "vol_13w": "vol_13w", "vol_26w": "vol_26w", "vol_ratio": div("vol_13w", "vol_26w"),
    "downside_vol_13w": f"{r('stddev_samp', 'down', 65, 40)} * sqrt(252.0)",
    "range_pct_4w": div("h20 - l20", '"close"'), "dist_52w_high": div('"close"', "c252") + " - 1",
    "dist_52w_low": div('"close"', "m252") + " - 1", "volume_z_13w": div("logv - lvm", "lvs"),
    "dollar_vol_log": 'ln(1 + "close" * volume)', "gap_1d": f"ln({div('open', 'pc')})",
    "close_to_high_1w": div('"close" - l5', "h5 - l5"),
    "skew_13w": _moment("skew"), "kurt_13w": _moment("kurt"),
    "max_ret_1m": r("max", "ret", 21, 15), "min_ret_1m": r("min", "ret", 21, 15),
    "up_day_frac_13w": r("avg", "up", 65, 40),
    "sma_ratio_10_50": div("s10", "s50") + " - 1", "sma_ratio_20_200": div("s20", "s200") + " - 1",
    "px_over_sma50": div('"close"', "s50") + " - 1", "px_over_sma200": div('"close"', "s200") + " - 1",
    "stoch_k_14": div('100 * ("close" - l14)', "h14 - l14"), "bb_position_20": div('"close" - s20', "2 * d20"),
    "bb_width_20": div("4 * d20", "s20"), "obv_slope_20": div(f"obv - {lag('obv', 20)}", "v20 * 20"),
    "money_flow_14": f"100 - 100 / (1 + {div(r('sum', 'pos', 14, 10), r('sum', 'neg', 14, 10))})",
    "higher_highs_12w": "hh", "higher_lows_12w": "hl", "trend_structure": "hh + hl - 1",
    "breakout_20d": "breakout_20d", "breakout_60d": div('"close"', lag("h60")) + " - 1",
    "breakdown_20d": div('"close"', lag("l20")) + " - 1",
    "dist_resistance_60d": div(f'{lag("h60", 3)} - "close"', '"close"'),
    "dist_support_60d": div(f'"close" - {lag("l60", 3)}', '"close"'),
    "squeeze_ratio": div("h20 - l20", "h60 - l60"), "consolidation_20d": div("h20 - l20", '"close"'),
    "gap_unfilled": """CASE WHEN pc IS NOT NULL THEN CASE WHEN gap > 0.005 AND low > pc THEN 1.0 ELSE 0.0 END
                       - CASE WHEN gap < -0.005 AND high < pc THEN 1.0 ELSE 0.0 END END""",
    "inside_bar_frac_4w": r("avg", "inside", 20, 15), "body_ratio_1w": r("avg", "body", 5, 3),
    "volume_breakout_conf": f"sign(coalesce(breakout_20d, 0)) * ln(1 + {div('volume', lag('v20'))})",
    "days_since_52w_high": """CASE WHEN max(hit) OVER (PARTITION BY ticker ORDER BY session) IS NOT NULL THEN
        least(rn - max(hit) OVER (PARTITION BY ticker ORDER BY session), 252) END""",
    "pullback_from_high_20d": div('"close"', "cx20") + " - 1",
}


def window_features(name: str = "feats", for_ranks: bool = False) -> list[str]:
    """CTEs ending in ``name``: every window feature of every bar.

    Values that will be ranked must tie where Spark's do. ``ln(1 + x)`` and ``log1p`` differ in the last bit, so for
    ranks this one column is rounded far below its spread.
    """
    columns = dict(COLUMNS)
    if for_ranks:
        columns["volume_breakout_conf"] = f"round({COLUMNS['volume_breakout_conf']}, 12)"
    out = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items())
    return [LEVEL_0, LEVEL_1, LEVEL_2, LEVEL_3, f"\n{name} AS (SELECT ticker, session, {out} FROM f3)"]


def _ew(c: str, alpha: float, least: int, name: str, source: str) -> str:
    """Closed form of the recursion, started at the first non-null value (no gaps afterwards)."""
    a, q = f"{alpha!r}::DOUBLE", f"{1 - alpha!r}::DOUBLE"
    return f"""
{name} AS (SELECT * EXCLUDE (e_k), CASE WHEN e_k >= {least} THEN pow({q}, e_k - 1) * sum(
      CASE WHEN {c} IS NOT NULL THEN CASE WHEN e_k = 1 THEN 1.0::DOUBLE ELSE {a} END * {c} * pow({q}, -(e_k - 1)) END)
      OVER (PARTITION BY ticker ORDER BY session) END AS {name}_v
  FROM (SELECT *, count({c}) OVER (PARTITION BY ticker ORDER BY session) AS e_k FROM {source}))"""


def smoothed_features(name: str = "smooth") -> list[str]:
    d = 'greatest(0, "close" - pc)'
    ups = "high - ph"
    downs = "pl - low"
    parts = [f"""
e0 AS (SELECT ticker, session, open, high, low, "close", pc, {lag('high')} AS ph, {lag('low')} AS pl FROM
       (SELECT *, {lag('"close"')} AS pc FROM bars))""", f"""
e1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN {d} END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(0, pc - "close") END AS loss,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN ph IS NOT NULL AND {ups} > {downs} AND {ups} > 0 THEN {ups} ELSE 0 END AS pdm,
  CASE WHEN ph IS NOT NULL AND {downs} > {ups} AND {downs} > 0 THEN {downs} ELSE 0 END AS mdm FROM e0)"""]
    source = "e1"
    for nm, c, alpha, least in (
        ("x20", '"close"', 2 / 21, 20), ("x12", '"close"', 2 / 13, 12), ("x26", '"close"', 2 / 27, 26),
        ("wg", "gain", 1 / 14, 14), ("wl", "loss", 1 / 14, 14), ("wt", "tr", 1 / 14, 14),
        ("wp", "pdm", 1 / 14, 14), ("wm", "mdm", 1 / 14, 14),
    ):
        parts.append(_ew(c, alpha, least, nm, source))
        source = nm
    parts.append(f"""
e2 AS (SELECT *, x12_v - x26_v AS macd, 100 * wp_v / nullif(wt_v, 0) AS pdi, 100 * wm_v / nullif(wt_v, 0) AS mdi FROM {source})""")
    parts.append("""
e3 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM e2)""")
    parts.append(_ew("macd", 2 / 10, 9, "sg", "e3"))
    parts.append(_ew("dx", 1 / 14, 14, "ax", "sg"))
    parts.append(f"""
{name} AS (SELECT ticker, session, (x20_v - {lag('x20_v', 10)}) / nullif("close", 0) AS ema_slope_20,
  macd / nullif("close", 0) AS macd_norm, (macd - sg_v) / nullif("close", 0) AS macd_hist_norm,
  rsi AS rsi_14, (rsi - 50) / 50 AS rsi_14_centered, wt_v / nullif("close", 0) AS atr_pct_14, ax_v AS adx_14,
  (pdi - mdi) / 100 AS di_spread_14
  FROM (SELECT *, CASE WHEN wl_v > 0 THEN 100 - 100 / (1 + wg_v / wl_v) WHEN wg_v > 0 THEN 100.0 ELSE 0.0 END AS rsi FROM ax))""")
    return parts


def market_features(name: str = "market") -> list[str]:
    w = "(ORDER BY session)"

    def s(fn, c, rows, least):
        return r(fn, c, rows, least).replace("PARTITION BY ticker ", "")

    def g(c, n):
        return f"lag({c}, {n}) OVER {w}"

    return [f"""
m0 AS (SELECT *, lc - {lag('lc')} AS ret, {r('avg', '"close"', 50, 35)} AS s50
       FROM (SELECT *, CASE WHEN "close" > 0 THEN ln("close") END AS lc FROM bars))""", """
m1 AS (SELECT session, avg(ret) AS mkt, stddev_samp(ret) AS spread,
         avg(CASE WHEN "close" > s50 THEN 1.0::DOUBLE WHEN s50 IS NOT NULL THEN 0.0::DOUBLE END) AS breadth_above_sma50,
         avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0.0::DOUBLE END) AS up FROM m0 GROUP BY session)""",
            f"""
m2 AS (SELECT *, sum(coalesce(mkt, 0)) OVER {w} AS idx, {s('stddev_samp', 'mkt', 65, 40)} * sqrt(252.0) AS mkt_vol_13w,
         {s('stddev_samp', 'mkt', 130, 80)} * sqrt(252.0) AS v26, {s('avg', 'up', 5, 3)} AS breadth_up_1w,
         {s('avg', 'spread', 5, 3)} * sqrt(252.0) AS dispersion_1w FROM m1)""", f"""
{name} AS (SELECT session, idx - {g('idx', 20)} AS mkt_mom_4w, idx - {g('idx', 60)} AS mkt_mom_12w, mkt_vol_13w,
         mkt_vol_13w / nullif(v26, 0) AS mkt_vol_ratio, breadth_above_sma50, breadth_up_1w, dispersion_1w,
         idx - max(idx) OVER {w} AS mkt_drawdown FROM m2)"""]
