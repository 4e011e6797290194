"""Book construction: selection, sizing, limits, bands and capacity.

Tables are keyed by ``by`` (default: the decision; add a scenario column for sweeps) and ticker. A book holds at most
``n_long + n_short`` names plus what is left of the previous one, so windows and arrays over a book stay small
whatever the universe. The selection itself ranks the whole universe and uses top-k windows, which Spark limits
before the shuffle.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import clip, col, div

BY = (S.DECISION,)
WEEKS_PER_YEAR = 52.0


@dataclass(frozen=True)
class Limits:
    max_weight: float = 0.12
    max_sector_weight: float = 0.35
    gross: float = 1.0
    max_net: float = 0.30
    min_weight: float = 0.001
    rounds: int = 8


def top_names(df: DataFrame, score: str, k: int, by=BY, *, highest: bool = True) -> DataFrame:
    """The ``k`` best rows of each group with their place; ties go by ticker."""
    order = [F.col(score).desc(), F.col(S.TICKER)] if highest else [F.col(score), F.col(S.TICKER).desc()]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.filter(F.col(score).isNotNull()).withColumn("place", place).filter(F.col("place") <= k)


def select_names(scores: DataFrame, *, n_long: int = 8, n_short: int = 7, score: str = "score", by=BY) -> DataFrame:
    """Best names with a positive score and worst names with a negative one; both sides shrink on thin dates."""
    sized = scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    fewer = F.greatest(F.lit(1), F.floor(F.col("_n") / 4).cast("int"))
    thin = F.col("_n") < 2 * (n_long + n_short)
    allowed = lambda k: F.when(thin, F.least(F.lit(k), fewer)).otherwise(F.lit(k))
    longs = top_names(scores.filter(F.col(score) > 0), score, n_long, by).withColumn("_long", F.lit(True))
    shorts = top_names(scores.filter(F.col(score) < 0), score, n_short, by, highest=False).withColumn("_long", F.lit(False))
    both = longs.unionByName(shorts).join(sized, list(by))
    return both.filter(F.col("place") <= F.when(F.col("_long"), allowed(n_long)).otherwise(allowed(n_short))).drop(
        "_n", "_long", "place")


def eligible_only(scores: DataFrame, eligibility: DataFrame, by=BY) -> DataFrame:
    """Keep the names flagged liquid at the decision; a name without a flag is out, a date without flags is not judged."""
    keys = [*by, S.TICKER]
    flags = eligibility.select(*keys, "liquid")
    judged = flags.select(*by).distinct().withColumn("_judged", F.lit(True))
    return (
        scores.join(judged, list(by), "left").join(flags, keys, "left")
        .filter(F.col("_judged").isNull() | F.coalesce("liquid", F.lit(False))).drop("_judged", "liquid")
    )


def _book(by):
    return Window.partitionBy(*by)


def equal_weights(selected: DataFrame, *, score: str = "score", by=BY) -> DataFrame:
    sign = F.signum(F.col(score))
    return selected.withColumn("weight", F.coalesce(div(sign, F.sum(F.abs(sign)).over(_book(by))), sign))


def inverse_vol_weights(selected: DataFrame, *, score: str = "score", vol: str = "volatility", floor_quantile: float = 0.10,
                        by=BY) -> DataFrame:
    """Sign over volatility. Missing volatility takes the median, and a floor keeps a dead name from dominating."""
    w = _book(by)
    positive = F.when(F.col(vol) > 0, F.col(vol))
    floor = F.greatest(F.percentile(positive, F.lit(floor_quantile)).over(w), F.lit(1e-4))
    used = F.greatest(F.coalesce(F.col(vol), F.percentile(positive, F.lit(0.5)).over(w)), floor)
    sign = F.signum(F.col(score))
    raw = F.when(F.count(positive).over(w) > 0, sign / used)
    out = selected.withColumn("_raw", raw).withColumn("_sign", sign)
    return out.withColumn("weight", F.coalesce(div("_raw", F.sum(F.abs("_raw")).over(w)), F.col("_sign"))).drop("_raw", "_sign")


def normalize_gross(book: DataFrame, gross: float = 1.0, *, by=BY) -> DataFrame:
    total = F.sum(F.abs("weight")).over(_book(by))
    return book.withColumn("weight", F.when(total > 1e-12, F.col("weight") * gross / F.nullif(total, F.lit(0.0)))
                           .otherwise(F.col("weight")))


def return_history(book: DataFrame, weekly: DataFrame, *, lookback: int = 104, by=BY) -> DataFrame:
    """Weekly returns of the book's names in complete weeks up to the decision.

    Names without any return in the look-back drop out first; a week counts only if every remaining name has one.
    Each decision is joined to its own list of weeks, so the history is reached by an equi-join on (ticker, week).
    """
    weeks = weekly.select(S.SESSION).distinct().withColumn(
        "_i", F.row_number().over(Window.orderBy(S.SESSION)))  # one row per week
    dates = book.select(S.DECISION).distinct()
    last = weeks.select(F.col(S.SESSION).alias("_s"), "_i")
    spans = dates.join(last, F.col("_s") <= F.col(S.DECISION)).groupBy(S.DECISION).agg(F.max("_i").alias("_i"))
    spans = spans.select(S.DECISION, F.explode(F.sequence(F.greatest(F.lit(1), F.col("_i") - (lookback - 1)), F.col("_i"))).alias("_i"))
    spans = spans.join(weeks, "_i").drop("_i")
    keys = list(dict.fromkeys([*by, S.DECISION]))
    past = (
        book.select(*keys, S.TICKER, "weight").join(spans, S.DECISION)
        .join(weekly.select(S.TICKER, S.SESSION, "weekly_return"), [S.TICKER, S.SESSION])
        .filter(F.col("weekly_return").isNotNull())
    )
    names = past.groupBy(*by).agg(F.count_distinct(S.TICKER).alias("n_names"))
    full = past.groupBy(*by, S.SESSION).agg(F.count("*").alias("_k")).join(names, list(by)).filter("_k = n_names")
    return past.join(full.select(*by, S.SESSION, "n_names"), [*by, S.SESSION])


def _shrinkage(n_names, n_weeks) -> Column:
    return clip(col(n_names) / F.greatest(col(n_weeks), F.lit(1)), 0.1, 0.9)


def shrunk_covariance(history: DataFrame, *, by=BY) -> DataFrame:
    """Covariance of a book's names shrunk to constant correlation: one row per pair, at most the book size squared."""
    a = history.select(*by, S.SESSION, F.col(S.TICKER).alias("ticker_i"), F.col("weekly_return").alias("ri"), "n_names")
    b = history.select(*by, S.SESSION, F.col(S.TICKER).alias("ticker_j"), F.col("weekly_return").alias("rj"))
    pairs = a.join(b, [*by, S.SESSION]).groupBy(*by, "ticker_i", "ticker_j", "n_names").agg(
        F.covar_samp("ri", "rj").alias("cov"), F.stddev_samp("ri").alias("si"), F.stddev_samp("rj").alias("sj"),
        F.count("*").alias("n_weeks")).filter("n_weeks >= 10 and n_names >= 2")
    same = F.col("ticker_i") == F.col("ticker_j")
    corr = F.coalesce(div("cov", F.col("si") * F.col("sj")), F.lit(0.0))
    mean = F.avg(F.when(~same, corr)).over(_book(by))
    k = _shrinkage("n_names", "n_weeks")
    target = F.when(same, F.col("cov")).otherwise(F.col("_mean") * F.col("si") * F.col("sj"))
    return pairs.withColumn("_mean", mean).select(
        *by, "ticker_i", "ticker_j", (k * target + (1.0 - k) * F.col("cov")).alias("covariance"))


def portfolio_volatility(history: DataFrame, *, by=BY) -> DataFrame:
    """Annual volatility of each book under its shrunk covariance, without forming the matrix.

    The sample part is the variance of the weighted return; the mean correlation follows from the variance of the sum
    of standardised returns; the target part needs only the weighted deviations. Two aggregates over the history
    replace all pairs.
    """
    each = history.groupBy(*by, S.TICKER).agg(F.stddev_samp("weekly_return").alias("_sd"))
    scaled = history.join(each, [*by, S.TICKER])
    weekly = scaled.groupBy(*by, S.SESSION, "n_names").agg(
        F.sum(F.col("weight") * F.col("weekly_return")).alias("_p"),
        F.sum(F.coalesce(div("weekly_return", "_sd"), F.lit(0.0))).alias("_z"))
    series = weekly.groupBy(*by, "n_names").agg(
        F.var_samp("_p").alias("_sample"), F.var_samp("_z").alias("_vz"), F.count("*").alias("n_weeks"))
    names = each.join(history.select(*by, S.TICKER, "weight").distinct(), [*by, S.TICKER]).groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("_sd")).alias("_ws"), F.sum(F.pow(F.col("weight") * F.col("_sd"), 2)).alias("_ws2"),
        F.count_if(F.col("_sd") > 0).alias("_live"))
    n, k = F.col("n_names"), _shrinkage("n_names", "n_weeks")
    corr = (F.col("_vz") - F.col("_live")) / F.nullif(n * (n - 1), F.lit(0))
    target = corr * (F.pow("_ws", F.lit(2.0)) - F.col("_ws2")) + F.col("_ws2")
    variance = k * target + (1.0 - k) * F.col("_sample")
    return series.join(names, list(by)).filter("n_weeks >= 10 and n_names >= 2").select(
        *by, (F.sqrt(F.greatest(variance, F.lit(0.0))) * WEEKS_PER_YEAR ** 0.5).alias("book_vol"))


def scale_to_target_vol(book: DataFrame, book_vol: DataFrame, *, target: float = 0.12, max_scale: float = 3.0,
                        vol: str = "volatility", median_vol: DataFrame | None = None, by=BY) -> DataFrame:
    """Scale each book to the target. Without a covariance the names are taken as uncorrelated.

    ``median_vol`` (``by``, median_vol) fills a name's missing volatility in that fallback; default is the book's own.
    """
    w = _book(by)
    out = book.join(book_vol, list(by), "left")
    if median_vol is not None:
        out = out.join(median_vol, list(by), "left")
    else:
        out = out.withColumn("median_vol", F.percentile(F.col(vol), F.lit(0.5)).over(w))
    alone = F.sqrt(F.sum(F.pow(F.col("weight") * F.coalesce(F.col(vol), F.col("median_vol")), F.lit(2.0))).over(w))
    current = F.when(F.coalesce("book_vol", F.lit(0.0)) > 1e-6, F.col("book_vol")).otherwise(alone)
    scale = F.when(F.col("_current") > 1e-6, clip(target / F.nullif("_current", F.lit(0.0)), 1.0 / max_scale, max_scale))
    return out.withColumn("_current", current).withColumn("vol_scale", F.coalesce(scale, F.lit(1.0))).withColumn(
        "weight", F.col("weight") * F.col("vol_scale")).drop("_current", "book_vol", "median_vol")


def kelly_cap(book: DataFrame, *, mu: str = "expected_return", vol: str = "volatility", fraction: float = 0.25, by=BY) -> DataFrame:
    """Fractional Kelly ceiling, applied last in sizing. No expected return means no ceiling, never a ceiling of zero."""
    filled = F.greatest(F.coalesce(F.col(vol), F.percentile(F.col(vol), F.lit(0.5)).over(_book(by))), F.lit(1e-3))
    sigma = F.when(F.count(vol).over(_book(by)) > 0, filled)
    ceiling = F.least(F.abs(F.col(mu) / F.pow(F.col("_sigma"), F.lit(2.0))) * fraction, F.lit(1.0))
    kept = F.when(F.col(mu).isNull() | F.col("_sigma").isNull(), F.abs("weight")).otherwise(F.least(F.abs("weight"), ceiling))
    return book.withColumn("_sigma", sigma).withColumn("weight", F.signum("weight") * kept).drop("_sigma")


def apply_limits(book: DataFrame, limits: Limits = Limits(), *, by=BY) -> DataFrame:
    """Enforce name, sector, gross and net limits; the book is only ever scaled down.

    The caps interact, so they repeat for a fixed number of rounds or until nothing moves. The rounds run over one
    array per book inside a single expression instead of a window per step.
    """
    others = [c for c in book.columns if c not in (*by, "weight")]
    has_sector = S.SECTOR in book.columns
    sector = F.coalesce(F.col(S.SECTOR), F.lit("Unknown")) if has_sector else F.lit("all")
    item = F.struct(F.col("weight").alias("w"), sector.alias("s"), F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    packed = book.groupBy(*by).agg(F.array_sort(
        F.collect_list(item), lambda a, b: F.when(a["rest"][S.TICKER] < b["rest"][S.TICKER], -1).when(
            a["rest"][S.TICKER] > b["rest"][S.TICKER], 1).otherwise(0)).alias("b"))
    capped = F.aggregate(
        F.sequence(F.lit(1), F.lit(limits.rounds)),
        F.struct(_scale_gross(F.col("b"), limits, 0.0).alias("b"), F.lit(False).alias("done")),
        lambda state, _: F.when(state["done"], state).otherwise(_round(state["b"], limits, has_sector)),
        lambda state: _trim_net(_drop_dust(state["b"], limits), limits))
    out = packed.withColumn("x", F.explode(capped))
    return out.select(*by, *[F.col(f"x.rest.{c}").alias(c) for c in others], F.col("x.w").alias("weight")).select(*book.columns)


def _total(book, value, keep=None) -> Column:
    items = F.filter(book, keep) if keep is not None else book
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _with(book, weight) -> Column:
    return F.transform(book, lambda x: F.struct(weight(x).alias("w"), x["s"].alias("s"), x["rest"].alias("rest")))


def _scale_gross(book, limits: Limits, slack: float) -> Column:
    gross = _total(book, lambda x: F.abs(x["w"]))
    return F.when(gross > limits.gross + slack, _with(book, lambda x: x["w"] * (limits.gross / gross))).otherwise(book)


def _round(before, limits: Limits, has_sector: bool) -> Column:
    named = _with(before, lambda x: F.signum(x["w"]) * F.least(F.abs(x["w"]), F.lit(limits.max_weight)))

    def sector_scaled(x):
        total = _total(named, lambda y: F.abs(y["w"]), lambda y: y["s"] == x["s"])
        return F.when(total > limits.max_sector_weight + 1e-12, x["w"] * (limits.max_sector_weight / total)).otherwise(x["w"])

    shaped = _with(named, sector_scaled) if has_sector else named
    after = _scale_gross(shaped, limits, 1e-12)
    still = F.forall(F.zip_with(after, before, lambda a, b: F.abs(a["w"] - b["w"]) <= 1e-12 + 1e-5 * F.abs(b["w"])), lambda ok: ok)
    return F.struct(after.alias("b"), still.alias("done"))


def _drop_dust(book, limits: Limits) -> Column:
    return _with(book, lambda x: F.when(F.abs(x["w"]) < limits.min_weight, 0.0).otherwise(x["w"]))


def _trim_net(book, limits: Limits) -> Column:
    net = _total(book, lambda x: x["w"])
    excess = F.abs(net) - limits.max_net
    side = lambda x: F.signum(x["w"]) == F.signum(net)
    gross = _total(book, lambda x: F.abs(x["w"]), side)
    trimmed = _with(book, lambda x: F.when(
        side(x), x["w"] * F.greatest(F.lit(0.0), 1.0 - excess / F.nullif(gross, F.lit(0.0)))).otherwise(x["w"]))
    return F.when((excess > 1e-12) & (gross > 1e-9), trimmed).otherwise(book)


def check_limits(book: DataFrame, limits: Limits = Limits(), *, tolerance: float = 1e-6, by=BY) -> DataFrame:
    """Every violated limit as (by..., rule, detail, value, bound); no rows means the book complies."""
    size = F.abs("weight")
    whole = book.groupBy(*by).agg(F.max(size).alias("weight"), F.sum(size).alias("gross"), F.abs(F.sum("weight")).alias("net"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit("").alias("detail"), F.col(name).alias("value"), F.lit(float(bound)).alias("bound"))
        for name, bound in (("weight", limits.max_weight), ("gross", limits.gross), ("net", limits.max_net))])
    out = whole.select(*by, F.explode(rules).alias("r")).select(*by, "r.*")
    if S.SECTOR in book.columns:
        sector = F.coalesce(F.col(S.SECTOR), F.lit("Unknown"))
        per = book.groupBy(*by, sector.alias("detail")).agg(F.sum(size).alias("value"))
        out = out.unionByName(per.select(*by, F.lit("sector").alias("rule"), "detail", "value",
                                         F.lit(limits.max_sector_weight).alias("bound")))
    return out.filter(F.col("value") > F.col("bound") + tolerance)


def _beside(target: DataFrame, previous: DataFrame, by) -> DataFrame:
    """Target and previous weight of every name in either book."""
    keys = [*by, S.TICKER]
    prev = previous.select(*keys, F.col("weight").alias("previous_weight"))
    return target.join(prev, keys, "full").withColumns({
        "weight": F.coalesce("weight", F.lit(0.0)), "previous_weight": F.coalesce("previous_weight", F.lit(0.0))})


def no_trade_band(target: DataFrame, previous: DataFrame, *, band: float = 0.005, by=BY) -> DataFrame:
    """Keep the previous weight where the change is too small to pay for; the band never opens a position."""
    both = _beside(target, previous, by)
    hold = (F.abs(F.col("weight") - F.col("previous_weight")) < band) & (F.abs("previous_weight") > 1e-9)
    kept = both.withColumn("weight", F.when(hold, F.col("previous_weight")).otherwise(F.col("weight")))
    return kept.filter(F.abs("weight") > 1e-9).drop("previous_weight")


def participation_cap(target: DataFrame, previous: DataFrame, adv: DataFrame, *, capital: float,
                      max_participation: float = 0.05, by=BY) -> DataFrame:
    """Cut each weight change to a share of the name's daily turnover and report what was cut."""
    change = F.col("weight") - F.col("previous_weight")
    allowed = F.col("adv_notional") * max_participation / capital
    both = _beside(target, previous, by).join(adv.select(*by, S.TICKER, "adv_notional"), [*by, S.TICKER], "left")
    breach = F.coalesce(F.abs(change) * capital > F.col("adv_notional") * max_participation, F.lit(False))
    out = both.withColumn("truncated", F.when(breach, F.abs(change) - allowed).otherwise(0.0)).withColumn(
        "weight", F.when(breach, F.col("previous_weight") + F.signum(change) * allowed).otherwise(F.col("weight")))
    return out.filter(F.abs("weight") > 1e-9).drop("previous_weight", "adv_notional")


def hard_to_borrow_filter(book: DataFrame, blocked: DataFrame) -> DataFrame:
    """Remove shorts in names that cannot be borrowed."""
    marked = blocked.select(S.TICKER).distinct().withColumn("_blocked", F.lit(True))
    return book.join(marked, S.TICKER, "left").filter(
        F.col("_blocked").isNull() | (F.col("weight") >= 0)).drop("_blocked")


def book_frame(book: DataFrame, *, short_instrument: str = "cash_equity") -> DataFrame:
    """Add instrument and side."""
    short = "futures" if short_instrument == "futures" else "equity_short"
    return book.withColumn("instrument", F.when(F.col("weight") >= 0, "equity").otherwise(short)).withColumn(
        "side", F.when(F.col("weight") < 0, "short").otherwise("long"))


def size_book(selected: DataFrame, *, weekly: DataFrame | None = None, sizing: str = "inverse_vol", limits: Limits = Limits(),
              target_vol: float = 0.12, kelly_fraction: float = 0.25, median_vol: DataFrame | None = None, by=BY) -> DataFrame:
    """Selection to weights: sizing rule, gross, volatility target, and the Kelly ceiling last so nothing undoes it."""
    if sizing == "equal" or "volatility" not in selected.columns:
        book = equal_weights(selected, by=by)
    else:
        book = inverse_vol_weights(selected, by=by)
    book = normalize_gross(book, limits.gross, by=by)
    if target_vol > 0 and "volatility" in selected.columns:
        if weekly is not None:
            vol = portfolio_volatility(return_history(book, weekly, by=by), by=by)
        else:
            vol = book.select(*by).distinct().withColumn("book_vol", F.lit(None).cast("double"))
        book = scale_to_target_vol(book, vol, target=target_vol, median_vol=median_vol, by=by)
    if sizing == "kelly" and kelly_fraction > 0 and {"expected_return", "volatility"} <= set(selected.columns):
        book = kelly_cap(book, fraction=kelly_fraction, by=by)
    return book


def build_book(scores: DataFrame, *, weekly: DataFrame | None = None, eligibility: DataFrame | None = None,
               previous: DataFrame | None = None, adv: DataFrame | None = None, capital: float | None = None,
               n_long: int = 8, n_short: int = 7, risk_scale: float | DataFrame = 1.0, band: float = 0.005,
               max_participation: float = 0.05, limits: Limits = Limits(), short_instrument: str = "cash_equity",
               by=BY, **sizing) -> DataFrame:
    """Scores to target weights for books that do not depend on each other.

    Limits run again after the band and after the capacity cap: both can push a book back over a limit, and the
    limits have the last word. ``risk_scale`` is one number or a table (by, risk_scale), where a book without a row keeps its size; a scale
    of zero is a flat book.
    """
    clean = eligible_only(scores, eligibility, by) if eligibility is not None else scores
    selected = select_names(clean, n_long=n_long, n_short=0 if short_instrument == "none" else n_short, by=by)
    book = size_book(selected, weekly=weekly, limits=limits, by=by, **sizing)
    if isinstance(risk_scale, DataFrame):
        book = book.join(risk_scale.select(*by, F.col("risk_scale").alias("_risk")), list(by), "left").withColumn("_risk", F.coalesce("_risk", F.lit(1.0)))
    else:
        book = book.withColumn("_risk", F.lit(float(risk_scale)))
    book = book.filter("_risk > 1e-9").withColumn("weight", F.col("weight") * F.col("_risk")).drop("_risk")
    book = apply_limits(book, limits, by=by)
    if previous is not None and band > 0:
        book = apply_limits(no_trade_band(book, previous, band=band, by=by), limits, by=by)
    if adv is not None and capital and max_participation > 0:
        before = previous if previous is not None else book.filter(F.lit(False))
        book = participation_cap(book, before, adv, capital=capital, max_participation=max_participation, by=by)
        book = apply_limits(book, limits, by=by)
    return book_frame(book.filter(F.abs("weight") > 1e-9), short_instrument=short_instrument)
