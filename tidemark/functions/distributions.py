"""Student t and normal probabilities: as column expressions, and as scalars on the driver."""

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def expected_max_sharpe(n_trials: int, variance: float = 1.0) -> float:
    """Expected best of ``n_trials`` worthless strategies."""
    if n_trials <= 1:
        return 0.0
    gamma, ppf = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(max(variance, 1e-12)) * (
        (1.0 - gamma) * ppf(1.0 - 1.0 / n_trials) + gamma * ppf(1.0 - 1.0 / (n_trials * math.e)))


def haircut_sharpe(observed: float, n_trials: int, n_observations: int) -> float:
    return 0.0 if n_observations < 20 else max(0.0, observed - expected_max_sharpe(n_trials))


def t_two_sided_col(t, dof) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite series in the angle; null for a null."""
    t, n = col(t), col(dof).cast("int")
    square = F.lit(1.0) / (1.0 + t * t / n)  # cosine squared of atan(t / sqrt(n))
    odd = n % 2 == 1
    terms = F.when(odd, F.floor((n - 1) / 2)).otherwise(F.floor(n / 2)).cast("int")
    first = F.when(odd, F.sqrt(square)).otherwise(F.lit(1.0))
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k)) * square
    series = F.aggregate(
        F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("sum"), first.alias("term")),
        lambda s, k: F.struct((s["sum"] + s["term"] * ratio(k)).alias("sum"), (s["term"] * ratio(k)).alias("term")), lambda s: s["sum"])
    sine = F.sqrt(1.0 - square)
    angle = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    inside = F.when(odd, (angle + F.when(terms > 0, sine * series).otherwise(0.0)) * (2.0 / math.pi)).otherwise(sine * series)
    return F.greatest(F.lit(0.0), 1.0 - inside)


def normal_cdf_col(z) -> Column:
    """Standard normal probability, by the series whose terms are all of one sign; 0 or 1 beyond ten deviations."""
    z = col(z)
    x = F.abs(z)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(220)), F.struct(x.alias("sum"), x.alias("term")),
        lambda s, k: F.struct((s["sum"] + s["term"] * x * x / (2.0 * k + 1.0)).alias("sum"), (s["term"] * x * x / (2.0 * k + 1.0)).alias("term")), lambda s: s["sum"])
    upper = F.when(x > 10.0, 1.0).otherwise(0.5 + F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi) * total)
    return F.when(z < 0, 1.0 - upper).when(z >= 0, upper)


def normal_upper_quantile_col(q) -> Column:
    """The deviation that a standard normal exceeds with probability ``q`` (0 < q <= 1/2): a rational start, then Newton steps."""
    q = col(q)
    t = F.sqrt(-2.0 * F.ln(q))
    # The published rational approximation, within 4.5e-4
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    # the state of the steps is one number, so the expression does not grow with their number
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), x, lambda s, _: s + ((1.0 - normal_cdf_col(s)) - q) * F.exp(s * s / 2.0) * math.sqrt(2.0 * math.pi))


def expected_max_sharpe_col(n_trials, variance=1.0) -> Column:
    """Expected best of worthless strategies; 0 for one trial or none."""
    n, gamma = col(n_trials).cast("double") if not isinstance(n_trials, (int, float)) else F.lit(float(n_trials)), 0.5772156649015329
    variance = F.lit(float(variance)) if isinstance(variance, (int, float)) else col(variance)
    many = F.when(n > 1, n)
    upper = lambda q: F.when(q <= 0.5, normal_upper_quantile_col(F.least(q, F.lit(0.5)))).otherwise(-normal_upper_quantile_col(F.greatest(F.least(1.0 - q, F.lit(0.5)), F.lit(1e-300))))
    best = (1.0 - gamma) * upper(1.0 / many) + gamma * upper(1.0 / (many * math.e))
    return F.coalesce(F.sqrt(F.greatest(variance, F.lit(1e-12))) * best, F.lit(0.0))


def haircut_sharpe_col(observed, n_trials, n_observations) -> Column:
    enough = col(n_observations) >= 20
    return F.when(enough, F.greatest(F.lit(0.0), col(observed) - expected_max_sharpe_col(n_trials))).otherwise(0.0)
