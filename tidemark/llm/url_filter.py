"""URL filter: rules, and for the rest a ratio of two character language models. DataFrame operations only.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over all URLs; contexts reach ``ORDER - 1``
characters and are smoothed by Witten-Bell interpolation, so an unseen character falls back to the next shorter context. A URL's
figure is the difference of its log-likelihoods under the two models for each character; the cut is calibrated on the counted URLs.

The model holds one row for each character sequence met: characters are reduced to 40 signs, so it has at most 40 + 40^2 + 40^3 + 40^4
(2.6 million) rows of four characters and two numbers at any input, below 100 MB; that bound lets it be broadcast always.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import lower_ascii, session
from tidemark.session import materialise

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Beginnings of words that mark a URL as an example of the rejected kind; every other URL is an example of the accepted kind.
SEEDS = ("adult", "bets", "casino", "clickbait", "escort", "gambl", "hentai", "jackpot", "lottery", "malware", "payday", "pharma", "phish", "pills",
         "poker", "porn", "replica", "slots", "spam", "torrent", "viagra", "warez", "xxx")
ORDER, SIGNS = 4, 40
_OTHER = r"[^a-z0./_%+=,:\-]"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null. A rule fits its host and all subdomains where the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def signs(host: Column, path: Column) -> Column:
    """What the models read: host and path in 40 signs, digits alike, with marks for start and end."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0"), _OTHER, "?")
    return F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("|"))


def _grams(types: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of each text: the sequences of 1 to ``ORDER`` characters that end there."""
    at = types.select("t", *keep, F.explode(F.sequence(F.lit(ORDER), F.length("t"))).alias("i"))
    return at.select("t", *keep, *(F.substring(F.col("t"), F.col("i") - (k - 1), F.lit(k)).alias(f"g{k}") for k in range(1, ORDER + 1)),
                     *(F.substring(F.col("t"), F.col("i") - k, F.lit(k)).alias(f"c{k}") for k in range(1, ORDER)))


def fit(types: DataFrame) -> DataFrame:
    """(gram, v, b): for each sequence the log-ratio v of its last character after the others, and the log-ratio b of backing off from
    it as a context. The empty sequence holds the back-off of no context. ``types``: texts ``t`` with counts ``accepted``, ``rejected``."""
    grams = _grams(types, "accepted", "rejected")
    counted = (grams.select("accepted", "rejected", F.explode(F.array(*(f"g{k}" for k in range(1, ORDER + 1)))).alias("gram"))
               .groupBy("gram").agg(F.sum("accepted").alias("n_a"), F.sum("rejected").alias("n_r")))
    counted = materialise(counted, "grams")
    lower = None
    parts = []
    for k in range(1, ORDER + 1):
        same = Window.partitionBy("context")  # at most 40 rows share a context
        level = counted.where(F.length("gram") == k).withColumn("context", F.substring("gram", 1, k - 1))
        for c in "ar":
            level = level.withColumns({f"all_{c}": F.sum(f"n_{c}").over(same), f"kinds_{c}": F.sum((F.col(f"n_{c}") > 0).cast("int")).over(same)})
        if lower is None:
            level = level.withColumns({"below_a": F.lit(1.0 / SIGNS), "below_r": F.lit(1.0 / SIGNS)})
        else:
            short = lower.select(F.col("gram").alias("suffix"), F.col("p_a").alias("below_a"), F.col("p_r").alias("below_r"))
            level = level.withColumn("suffix", F.substring("gram", 2, k - 1)).join(short, "suffix")
        for c in "ar":
            n = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            level = level.withColumns({f"p_{c}": F.when(n == 0, F.col(f"below_{c}")).otherwise((F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"below_{c}")) / n),
                                       f"away_{c}": F.when(n == 0, F.lit(1.0)).otherwise(F.col(f"kinds_{c}") / n)})
        lower = materialise(level.select("gram", "context", "p_a", "p_r", "away_a", "away_r"), "level")
        parts.append(lower)
    # the logarithm of no back-off at all would be minus infinity only where no context was met, and then away is 1
    values = reduce(DataFrame.union, (p.select("gram", F.log(F.col("p_a") / F.col("p_r")).alias("v"), F.lit(None).cast("double").alias("b")) for p in parts))
    backs = reduce(DataFrame.union, (p.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("v"),
                                              F.log(F.col("away_a") / F.col("away_r")).alias("b")) for p in parts))
    return materialise(values.union(backs).groupBy("gram").agg(F.max("v").alias("v"), F.max("b").alias("b")), "model")


def scores(types: DataFrame, model: DataFrame) -> DataFrame:
    """(t, score): the mean log-ratio of a character, positive where the accepted model fits better."""
    none = model.where("gram = ''").select("b").first()
    rows = _grams(types)

    def look(rows: DataFrame, key: str, value: str) -> DataFrame:
        side = model.where(F.col(value).isNotNull()).select(F.col("gram").alias(key), F.col(value).alias(f"{value}_{key}"))
        return rows.join(F.broadcast(side), key, "left")  # bounded by the signs

    for k in range(1, ORDER + 1):
        rows = look(rows, f"g{k}", "v")
    for k in range(1, ORDER):
        rows = look(rows, f"c{k}", "b")
    value = F.coalesce(F.col("v_g1"), F.lit(none.b if none and none.b is not None else 0.0))
    for k in range(2, ORDER + 1):
        value = F.coalesce(F.col(f"v_g{k}"), F.coalesce(F.col(f"b_c{k - 1}"), F.lit(0.0)) + value)
    return rows.groupBy("t").agg(F.avg(value).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The cut with the largest share of rejected below it less the share of accepted, over counts in steps of 0.01."""
    steps = (scored.groupBy(F.round(F.greatest(F.least("score", F.lit(20.0)), F.lit(-20.0)), 2).alias("s"))
             .agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))  # at most 4,001 rows
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = (F.sum("r").over(upto) / F.greatest(F.sum("r").over(all_rows), F.lit(1)) - F.sum("a").over(upto) / F.greatest(F.sum("a").over(all_rows), F.lit(1)))
    best = steps.select("s", gain.alias("gain"), F.lead("s").over(Window.orderBy("s")).alias("after")).orderBy(F.desc("gain"), "s").first()
    if best is None or best.gain is None or best.gain <= 0:
        return -20.01  # nothing tells the kinds apart: reject nothing
    return (best.s + (best.after if best.after is not None else best.s + 0.02)) / 2


def filter_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    The verdict is the rule's, else "block" where the score lies below the calibrated cut and "allow" otherwise. A null url and one
    without ``://`` have empty host and path, fit no rule and are scored as empty texts. Without any rejected example nothing is
    blocked by score. Null ids and repeated rows stay; an empty table gives an empty result; other columns, however named, are
    ignored. Texts are scored once for each distinct text; the join back may be split, so one host may hold any share of the rows.
    """
    session(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "t": signs(F.col("host"), F.col("path"))})
    rejected = F.col("t").rlike(f"(?:^|[^a-z])(?:{'|'.join(seeds)})") if seeds else F.lit(False)
    types = materialise(rows.groupBy("t").agg(F.count("*").alias("n")).select(
        "t", F.when(rejected, 0).otherwise(F.col("n")).alias("accepted"), F.when(rejected, F.col("n")).otherwise(0).alias("rejected")), "types")
    scored = materialise(types.join(scores(types, fit(types)), "t"), "scored")
    cut = calibrate(scored)
    verdicts = reduce(lambda out, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(out), rules, F.when(F.col("score") < cut, "block").otherwise("allow"))
    return rows.join(scored.select("t", "score"), "t").select("page_id", "host", "path", "rule", verdicts.alias("verdict"), "score")
