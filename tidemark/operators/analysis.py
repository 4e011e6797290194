"""Article analyses as a table: repair, scores, incremental runs, flattening."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S
from tidemark.functions import text
from tidemark.functions.exprs import clip, finite

# The closed list of event types, and of roles an entity can have.
EVENT_TYPES = (
    "earnings_beat", "earnings_miss", "earnings_inline", "guidance_up", "guidance_down", "m_and_a_target",
    "m_and_a_acquirer", "regulatory_approval", "regulatory_action", "litigation", "product_launch", "contract_win",
    "exec_change", "dilution", "buyback", "dividend_change", "analyst_action", "credit_rating",
    "operational_disruption", "macro", "opinion_commentary", "recap", "other",
)
ENTITY_ROLES = ("primary", "peer", "supplier", "customer", "acquirer", "target", "index")
SCHEMA_VERSION = "1"


def signed_score() -> Column:
    """Direction, confidence and materiality in one number, discounted for rumour, rehash and macro pieces."""
    direction = F.when(F.col("expected_direction") == "up", 1.0).when(
        F.col("expected_direction") == "down", -1.0).otherwise(0.0)
    factor = lambda cond, f: F.when(cond, f).otherwise(1.0)
    return (
        direction * F.col("direction_confidence") * (F.col("magnitude") / 3.0)
        * factor(F.col("is_speculative"), 0.5) * factor(F.col("is_recap"), 0.3)
        * factor(~F.col("is_company_specific"), 0.4)
    )


def repair(df: DataFrame, *, rationale_chars: int | None = None) -> DataFrame:
    """Clamp and default analysis fields that arrive as free-form text or numbers, so one bad field costs one field."""
    number = lambda c: finite(F.expr(f"try_cast(`{c}` as double)"))
    known = lambda c, allowed, default: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(default)
    why = F.coalesce("rationale", F.lit("")) if "rationale" in df.columns else F.lit("")
    fixes = {
        "event_type": known("event_type", EVENT_TYPES, "other"),
        "sentiment": F.coalesce(clip(number("sentiment"), -1.0, 1.0), F.lit(0.0)),
        "direction_confidence": F.coalesce(clip(number("direction_confidence"), 0.0, 1.0), F.lit(0.0)),
        "magnitude": F.coalesce(clip(F.bround(number("magnitude")), 0.0, 3.0), F.lit(0.0)).cast("int"),
        "numeric_surprise_pct": clip(number("numeric_surprise_pct"), -500.0, 500.0),
        "expected_direction": known("expected_direction", ("up", "down", "neutral"), "neutral"),
        "rationale": why if rationale_chars is None else F.substring(why, 1, rationale_chars),
    }
    return df.withColumns({c: e for c, e in fixes.items() if c in df.columns})


def merge_sentiment_model(analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """Let a sentiment model's (content_hash, label, score) override tone, direction and confidence."""
    label = F.lower(F.coalesce("_label", F.lit("")))
    tone = F.when(label.startswith("pos"), F.col("_score")).when(label.startswith("neg"), -F.col("_score")).otherwise(0.0)
    scored = scores.select("content_hash", F.col("label").alias("_label"), F.col("score").alias("_score"))
    has = F.col("_label").isNotNull()
    return (
        analyses.join(scored, "content_hash", "left")
        .withColumn("sentiment", F.when(has, tone).otherwise(F.col("sentiment")))
        .withColumn("expected_direction", F.when(~has, F.col("expected_direction")).when(
            F.col("sentiment") > 0.15, "up").when(F.col("sentiment") < -0.15, "down").otherwise("neutral"))
        .withColumn("direction_confidence", F.when(
            has, F.round(F.abs("sentiment"), 3)).otherwise(F.col("direction_confidence")))
        .drop("_label", "_score")
    )


def pending(articles: DataFrame, analysed: DataFrame, *, backend: str, model_id: str, prompt_version: str = "v1",
            max_articles: int | None = None) -> DataFrame:
    """Articles whose key has neither a result nor a recorded failure; the optional cap is a spending limit."""
    keyed = articles.withColumn("key", text.cache_key("content_hash", backend, model_id, prompt_version, SCHEMA_VERSION))
    todo = keyed.join(analysed.select("key"), "key", "left_anti")
    return todo.orderBy(S.TICKER, S.AVAILABLE_AT, "key").limit(max_articles) if max_articles else todo


def analyse_pending(todo: DataFrame, analyse: Callable[[DataFrame], DataFrame], *, backend: str, model_id: str) -> DataFrame:
    """Run an analyzer over distinct texts and record a row for each key, ``failed`` where it returned nothing.

    Copies of one text share a key and are analysed once. ``analyse`` adds the analysis columns; a null
    ``event_type`` is a failure, which stays explicit instead of turning into a neutral reading.
    """
    once = todo.dropDuplicates(["key"])
    done = analyse(once)
    ok = F.col("event_type").isNotNull()
    return done.withColumn("status", F.when(ok, "ok").otherwise("failed")).withColumn(
        "error", F.when(~ok, "analyzer returned no result")).withColumns(
        {"backend": F.lit(backend), "model_id": F.lit(model_id)})


def analysis_stats(analysed: DataFrame, spend: DataFrame | None = None) -> DataFrame:
    """Entries, successes, failures and spend of each backend."""
    out = analysed.groupBy("backend").agg(
        F.count("*").alias("entries"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"))
    if spend is None:
        return out.withColumn("spend_usd", F.lit(0.0))
    spent = spend.groupBy("backend").agg(F.sum("usd").alias("spend_usd"))
    return out.join(spent, "backend", "left").withColumn("spend_usd", F.coalesce("spend_usd", F.lit(0.0)))


def flatten_records(records: DataFrame) -> DataFrame:
    """Nested extraction records as the flat table the news features read."""
    fields = ("event_type", "sentiment", "magnitude", "is_speculative", "is_recap", "is_company_specific",
              "expected_direction", "direction_confidence", "numeric_surprise_pct")
    flat = records.select(
        "content_hash", S.TICKER, "published_at", "first_seen_at",
        F.greatest("published_at", "first_seen_at").alias(S.AVAILABLE_AT),
        *[F.col(f"analysis.{c}").alias(c) for c in fields], "novelty", "backend", "source")
    return flat.withColumn("signed_score", signed_score())


def with_batch_analyzer(articles: DataFrame, analyse_batch: Callable, fields: list[str] | None = None, *, key: str = "content_hash") -> DataFrame:
    """Plug in an analyzer that takes a pandas batch of articles and returns a frame of ``key`` and analysis columns.

    Answers are matched by key, not by place, so an analyzer may answer in any order. ``status`` says what came back for a row: "ok";
    "missing" for an article without an answer, its analysis null; "repeated" where a key was answered more than once (the first answer
    stands); "failed" for every article of a batch whose analyzer raised, with ``error``. An answer to a key that was not asked adds a row
    of its own, all article columns but the key null, "unasked". Articles that share a key share the answer. Batches stream over Arrow.
    """
    names = fields or [f.name for f in S.ANALYSIS.fields if f.name != "entities"]
    added = [T.StructField(f.name, f.dataType) for f in (S.ANALYSIS[n] for n in names)]
    schema = T.StructType([*articles.schema.fields, *added, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    asked_columns = articles.columns

    def run(batches):
        for batch in batches:
            try:
                result, error = analyse_batch(batch), None
                answers = result[[key, *names]].astype(object)
            except Exception as raised:  # one bad batch is a status of its rows, not the end of the job
                answers, error = batch.iloc[:0].reindex(columns=[key, *names]).astype(object), f"{type(raised).__name__}: {raised}"
            repeated = set(answers[key][answers[key].duplicated()])
            first = answers.drop_duplicates(key)
            out = batch.merge(first, on=key, how="left", indicator="_found")
            found = out.pop("_found") == "both"
            out["status"] = ["failed" if error else "missing" if not f else "repeated" if k in repeated else "ok" for k, f in zip(out[key], found, strict=True)]
            out["error"] = error
            extra = first[~first[key].isin(set(batch[key]))]
            if len(extra):
                more = extra.reindex(columns=out.columns)
                more["status"] = "unasked"
                out = pd.concat([out.astype(object), more.astype(object)], ignore_index=True)
            yield out[[*asked_columns, *names, "status", "error"]].astype(object).where(lambda x: x.notna(), None)

    return articles.mapInPandas(run, schema)
