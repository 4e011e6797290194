"""Lexicon reading of articles: tone, event class, flags, materiality, direction, stated surprise.

Everything is a column expression over whole texts; word lists become hash sets inside the generated code.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon_values as V
from tidemark.functions import text
from tidemark.functions.exprs import clip, col
from tidemark.functions.lexicon_values import Lexicon

BACKEND = "lexicon"
MODEL_ID = "word-list-v1"


def _listed(word: Column, lex: Lexicon) -> Column:
    return F.when(word.isin(*lex.positive), 1.0).when(word.isin(*lex.negative), -1.0)


def polarity(word: Column, lex: Lexicon = Lexicon()) -> Column:
    """Tone of a word: as listed, else after taking off an ending (and putting back a final e)."""
    tries = [_listed(word, lex)]
    for suffix in V.SUFFIXES:
        cut = word.endswith(F.lit(suffix)) & (F.length(word) > len(suffix) + 2)
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        tries.append(F.when(cut, _listed(stem, lex)))
        if suffix in ("ed", "ing"):
            tries.append(F.when(cut, _listed(F.concat(stem, F.lit("e")), lex)))
    return F.coalesce(*tries, F.lit(0.0))


def tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"[a-z][a-z'\-]+"), F.lit(0))


def _weighted(words: Column, lex: Lexicon) -> Column:
    """Tone of each word, turned by a negator and raised by an intensifier among the words just before it."""

    def one(word, i):
        tone = polarity(word, lex)
        before = F.slice(words, F.greatest(i - (lex.window - 1), F.lit(1)), F.least(i, F.lit(lex.window)))
        flip = F.when(F.exists(before, lambda w: w.isin(*lex.negators)), -1.0).otherwise(1.0)
        raise_ = F.when(F.exists(before, lambda w: w.isin(*lex.intensifiers)), 1.5).otherwise(1.0)
        return F.when(tone != 0.0, tone * flip * raise_).otherwise(0.0)

    return F.transform(words, one)


def _any(c: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def _count(c: Column, phrases) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + c.contains(p).cast("int")
    return out


def classify(lowered: Column, lex: Lexicon = Lexicon()) -> Column:
    """First event type with a matching phrase; then macro (two markers), opinion, other."""
    out = F
    for event, phrases in lex.event_patterns:
        out = out.when(_any(lowered, phrases), event)
    return out.when(_count(lowered, lex.macro) >= 2, "macro").when(_any(lowered, lex.opinion), "opinion_commentary").otherwise("other")


def apply_event_sign(sentiment, event) -> Column:
    """Let an event with a direction of its own override wording that is weak or contrary."""
    s, sign = col(sentiment), F
    for name, value in V.EVENT_SIGN.items():
        sign = sign.when(col(event) == name, value)
    sign = sign.otherwise(F.lit(None))
    return F.when(sign.isNull() | (s * sign >= 0.15), s).otherwise(sign * F.greatest(F.lit(V.EVENT_SIGN_FLOOR), F.abs(s)))


def magnitude(event, hits, length, recap) -> Column:
    loose = F.when((col(hits) >= 3) | (col(length) > 800), 1).otherwise(0)
    base = F.when(col(event).isin(*V.MAJOR), 3).when(col(event).isin(*V.NOTABLE), 2).when(
        col(event).isin(*V.LOOSE), loose).otherwise(1)
    return F.when(col(recap), F.least(base, F.lit(1))).otherwise(base)


# The pattern of a stated surprise; the thresholds of tone, length, confidence and direction in this module.
SURPRISE = r"(beat|miss|above|below|versus|vs\.?|against)\D{0,30}?(\d{1,3}(?:\.\d+)?)\s*(?:per cent|percent|%)"


def surprise(lowered) -> Column:
    """Percentage an article states against expectations, negative for a shortfall."""
    value = F.regexp_extract(col(lowered), SURPRISE, 2).try_cast("double")
    return F.when(F.regexp_extract(col(lowered), SURPRISE, 1).isin("miss", "below"), -value).otherwise(value)


def analyse(articles: DataFrame, lex: Lexicon = Lexicon()) -> DataFrame:
    """Add the analysis columns to articles with title and body."""
    c = F.col
    head = F.lower("title")
    out = articles.withColumn("_text", text.article_text()).withColumn("_low", F.lower("_text"))
    out = out.withColumn("_words", tokens(F.concat(head, F.lit(" "), head, F.lit(" "), c("_low"))))
    out = out.withColumn("_scores", _weighted(c("_words"), lex))
    hits = F.size(F.filter("_scores", lambda x: x != 0.0))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x)
    raw = F.when(c("_hits") > 0, clip(total / (F.sqrt(F.nullif(c("_hits"), F.lit(0))) * 2.0), -1.0, 1.0)).otherwise(0.0)
    out = out.withColumns({"_hits": hits, "_event": classify(c("_low"), lex)}).withColumns({
        "_raw": raw, "is_recap": _any(c("_low"), lex.recap), "is_speculative": _any(c("_low"), lex.speculative),
        "is_company_specific": ~((c("_event") == "macro") | (_count(c("_low"), lex.macro) >= 2)),
        "numeric_surprise_pct": clip(surprise(c("_low")), -500.0, 500.0),
    })
    out = out.withColumn("sentiment", apply_event_sign("_raw", "_event"))
    confidence = F.least(F.lit(1.0), F.abs("sentiment") * 1.4 + F.least(c("_hits"), F.lit(6)) * 0.05)
    halved = F.when(c("_event").isin("opinion_commentary", "other", "recap"), confidence * 0.5).otherwise(confidence)
    return out.withColumns({
        "magnitude": magnitude("_event", "_hits", F.length("_text"), "is_recap"),
        "expected_direction": F.when(c("sentiment") > 0.08, "up").when(c("sentiment") < -0.08, "down").otherwise("neutral"),
        "direction_confidence": F.round(halved, 3),
        "event_type": F.when(c("is_recap") & (c("_event") == "other"), "recap").otherwise(c("_event")),
        "rationale": F.concat(F.lit("lexicon: "), c("_hits").cast("string"), F.lit(" sentiment term(s), event "), c("_event")),
        "n_hits": c("_hits"),
    }).drop("_text", "_low", "_words", "_scores", "_hits", "_event", "_raw")
