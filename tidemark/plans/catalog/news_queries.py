"""Text, article and news-feature queries."""

from pyspark.sql import functions as F

from tidemark.functions import lexicon_values as V
from tidemark.functions import text
from tidemark.functions.lexicon_values import Lexicon
from tidemark.operators import analysis, dedupe, lexicon
from tidemark.operators import calendar as cal
from tidemark.operators import news_features as nf
from tidemark.plans.catalog import base_sql as B
from tidemark.plans.catalog.registry import query
from tidemark.session import materialise
from tidemark.sources import fixtures as fx

MARKERS = text.WIRE_MARKERS


def norm_sql(c: str) -> str:
    out = f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    for m in MARKERS:
        out = f"replace({out}, '{m}', ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


ARTICLES = f"""
arts AS (
  SELECT *, regexp_replace(title || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g') AS full_text,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS available_at
  FROM (SELECT doc_id, lang AS ticker, source,
          CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
          CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents))"""


@query("n1_normalise_text", B.with_(ARTICLES) + f" SELECT doc_id, md5({norm_sql('full_text')}) AS normal FROM arts")
def _(spark, d):
    return fx.articles(spark, d).select("doc_id", F.md5(text.normalise_text(text.article_text())).alias("normal"))


GRAMS = f"""
normal AS (SELECT *, {norm_sql("title || ' ' || body")} AS opening FROM arts),
grams AS (SELECT *, CASE WHEN length(opening) = 0 THEN [] WHEN length(opening) < 5 THEN [opening] ELSE
          list_distinct([c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4] for i in range(1, len(c) - 3)]) END AS g
          FROM (SELECT *, string_split(opening, '') AS c FROM normal)),
each AS (SELECT doc_id, ticker, available_at, len(g) AS n, unnest(g) AS x FROM grams)"""


@query("n2_char_ngrams", B.with_(ARTICLES, GRAMS) + " SELECT doc_id, len(g)::INTEGER AS n_grams FROM grams")
def _(spark, d):
    opening = text.normalise_text(F.concat("title", F.lit(" "), "body"))
    arts = fx.articles(spark, d).select("doc_id", opening.alias("opening"))
    return arts.select("doc_id", F.size(text.char_ngrams("opening")).alias("n_grams"))


@query("n3_jaccard", B.with_(ARTICLES, GRAMS) + """
SELECT a.doc_id, coalesce(any_value(k), 0) / (any_value(len(a.g) + len(b.g)) - coalesce(any_value(k), 0))::DOUBLE AS overlap
FROM grams a JOIN grams b ON b.doc_id = a.doc_id + 1
LEFT JOIN (SELECT a.doc_id, count(*) AS k FROM each a JOIN each b ON b.doc_id = a.doc_id + 1 AND a.x = b.x GROUP BY 1) s ON s.doc_id = a.doc_id
WHERE len(a.g) > 0 AND len(b.g) > 0 GROUP BY a.doc_id""", "overlap")
def _(spark, d):
    """Overlap of each document with the next one."""
    opening = text.normalise_text(F.concat("title", F.lit(" "), "body"))
    arts = materialise(fx.articles(spark, d).select("doc_id", opening.alias("opening")), "openings")  # read by both sides, normalised once
    after = arts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("opening").alias("following"))
    return text.pair_overlaps(arts.join(after, "doc_id"), "opening", "following").select("doc_id", "overlap").filter("overlap is not null")


@query("n4_hashes", B.with_(ARTICLES) + f"""
SELECT doc_id, sha256({norm_sql('full_text')}) AS article_hash, sha256(lower(trim(regexp_replace(full_text, '\\s+', ' ', 'g'))))
       AS content_hash, substr(sha256(sha256({norm_sql('full_text')}) || '|lexicon|word-list-v1|v1|1'), 1, 32) AS cache_key FROM arts""")
def _(spark, d):
    a = fx.articles(spark, d).withColumnRenamed("content_hash", "article_hash")
    return a.select("doc_id", "article_hash", text.content_hash(text.article_text()).alias("content_hash"),
                    text.cache_key("article_hash", "lexicon", "word-list-v1", "v1").alias("cache_key"))


@query("n5_deduplicate", B.with_(ARTICLES, GRAMS, """
shared AS (SELECT a.doc_id AS other, b.doc_id, any_value(a.n + b.n) AS n, count(*) AS k FROM each a JOIN each b ON a.ticker = b.ticker AND a.x = b.x
             AND a.doc_id < b.doc_id AND a.available_at >= b.available_at - INTERVAL 72 HOUR AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY 1, 2),
near AS (SELECT doc_id AS id, list(other) AS nb FROM shared WHERE k / (n - k)::DOUBLE >= 0.6 GROUP BY 1),
seq AS (SELECT list({'id': doc_id, 'nb': coalesce(nb, []::BIGINT[])} ORDER BY doc_id) AS s FROM arts LEFT JOIN near ON id = doc_id),
kept AS (SELECT list_reduce(list_prepend({'id': -1::BIGINT, 'nb': []::BIGINT[]}, s),
           lambda k, x: {'id': x.id, 'nb': CASE WHEN list_has_any(k.nb, x.nb) THEN k.nb ELSE list_append(k.nb, x.id) END}).nb AS ids FROM seq)""") + """
SELECT doc_id, ticker FROM arts WHERE doc_id IN (SELECT unnest(ids) FROM kept)""")
def _(spark, d):
    """Articles left after near-duplicate collapse."""
    arts = fx.articles(spark, d).select("doc_id", "ticker", "title", "body", "available_at")  # what the pass needs: all given columns are stored
    return dedupe.deduplicate(arts, id_col="doc_id").select("doc_id", "ticker")


@query("n6_novelty", B.with_(ARTICLES, GRAMS, """
shared AS (SELECT a.doc_id, b.doc_id AS other, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM each a JOIN each b
             ON a.ticker = b.ticker AND a.x = b.x AND b.doc_id < a.doc_id AND b.available_at >= a.available_at - INTERVAL 7 DAY GROUP BY 1, 2),
best AS (SELECT doc_id, max(k / (n + m - k)::DOUBLE) AS j FROM shared GROUP BY 1)""") + """
SELECT doc_id, ticker, coalesce(1 - j, 1.0::DOUBLE) AS novelty FROM arts LEFT JOIN best USING (doc_id)""", "novelty")
def _(spark, d):
    return dedupe.novelty_scores(fx.articles(spark, d), id_col="doc_id").select("doc_id", "ticker", "novelty")


@query("n7_token_overlap", B.with_(ARTICLES, """
words AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t,
                 list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS b FROM arts)""") + """
SELECT doc_id, CASE WHEN len(list_intersect(t, b)) = 0 THEN 0.0::DOUBLE ELSE
  len(list_intersect(t, b)) / (len(t) + len(b) - len(list_intersect(t, b)))::DOUBLE END AS overlap FROM words""", "overlap")
def _(spark, d):
    return fx.articles(spark, d).select("doc_id", text.token_overlap("title", "body").alias("overlap"))


@query("n8_coverage_summary", B.with_(ARTICLES) + """
SELECT count(*) AS n_articles, count(DISTINCT ticker) AS n_tickers,
       round(count(*) / count(DISTINCT ticker)::DOUBLE, 2) AS articles_per_ticker, median(length(body))::DOUBLE AS median_body_chars,
       avg(CASE WHEN length(body) < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS headline_only_frac FROM arts""", "headline_only_frac")
def _(spark, d):
    return dedupe.coverage_summary(fx.articles(spark, d))


# Word lists drawn from the corpus, which has no company news in it.
CORPUS = Lexicon(
    positive=("the", "and", "le", "que", "la", "an"), negative=("of", "on", "du", "re", "un", "is"),
    negators=("by", "des", "at"), intensifiers=("in", "pour", "for"),
    event_patterns=(("m_and_a_target", ("the by", "du le")), ("earnings_miss", ("of and", "que la")), ("litigation", ("tion the",)),
                    ("exec_change", ("une ", "der ")), ("dividend_change", ("los ", "and in"))),
    macro=("and the", "for the", "par la", "le un"), opinion=("tre ", "with"), recap=("this is", "pour le", "on on"),
    speculative=("that by", "un la", "are of"))


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, {_quoted(p)})" for p in phrases) + ")"


def _count(phrases) -> str:
    return "(" + " + ".join(f"contains(low, {_quoted(p)})::INTEGER" for p in phrases) + ")"


def _polarity_sql(lex) -> str:
    listed = lambda w: f"CASE WHEN {w} IN {_list(lex.positive)} THEN 1.0 WHEN {w} IN {_list(lex.negative)} THEN -1.0 END"
    tries = [listed("w")]
    for s in ("s", "es", "ed", "ing", "d"):
        ok = f"length(w) > {len(s) + 2} AND ends_with(w, '{s}')"
        stem = f"left(w, length(w) - {len(s)})"
        tries.append(f"CASE WHEN {ok} THEN {listed(stem)} END")
        if s in ("ed", "ing"):
            tries.append(f"CASE WHEN {ok} THEN {listed(stem + chr(32) + '|| ' + chr(39) + 'e' + chr(39))} END")
    return "coalesce(" + ", ".join(tries) + ", 0.0)"


def _sign_sql() -> str:
    """An event with a direction of its own overrides weak or contrary wording."""
    cases = " ".join(f"WHEN '{e}' THEN CASE WHEN raw * {v} >= 0.15 THEN raw ELSE {v} * greatest({V.EVENT_SIGN_FLOOR}, abs(raw)) END" for e, v in V.EVENT_SIGN.items())
    return f"CASE event {cases} ELSE raw END"


def lexicon_sql(lex) -> list[str]:
    events = "CASE " + " ".join(f"WHEN {_any(p)} THEN '{e}'" for e, p in lex.event_patterns) + f"""
  WHEN {_count(lex.macro)} >= 2 THEN 'macro' WHEN {_any(lex.opinion)} THEN 'opinion_commentary' ELSE 'other' END"""
    return [f"""
low AS (SELECT doc_id, lower(full_text) AS low, length(full_text) AS chars,
        lower(title) || ' ' || lower(title) || ' ' || lower(full_text) AS scored FROM arts)""", """
toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
         FROM (SELECT doc_id, regexp_extract_all(scored, '[a-z][a-z''\\-]+') AS ws FROM low))""", f"""
toned AS (SELECT doc_id, {_polarity_sql(lex)} AS tone,
            coalesce(bool_or(w IN {_list(lex.negators)}) OVER b, FALSE) AS neg,
            coalesce(bool_or(w IN {_list(lex.intensifiers)}) OVER b, FALSE) AS strong FROM toks
          WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""", """
tones AS (SELECT doc_id, count(*) FILTER (tone <> 0) AS hits,
            sum(tone * CASE WHEN neg THEN -1 ELSE 1 END * CASE WHEN strong THEN 1.5 ELSE 1 END)::DOUBLE AS total FROM toned GROUP BY 1)""", f"""
flags AS (SELECT low.*, coalesce(hits, 0) AS hits,
            CASE WHEN coalesce(hits, 0) = 0 THEN 0 ELSE greatest(-1, least(1, total / (sqrt(hits) * 2.0))) END AS raw,
            {events} AS event, {_any(lex.recap)} AS is_recap, {_any(lex.speculative)} AS is_speculative,
            {_count(lex.macro)} >= 2 AS macro FROM low LEFT JOIN tones USING (doc_id))""", f"""
signed AS (SELECT *, {_sign_sql()} AS sentiment FROM flags)""", f"""
read AS (SELECT *, CASE WHEN is_recap AND event = 'other' THEN 'recap' ELSE event END AS event_type,
           CASE WHEN is_recap THEN least(1, mag) ELSE mag END AS magnitude,
           CASE WHEN sentiment > 0.08 THEN 'up' WHEN sentiment < -0.08 THEN 'down' ELSE 'neutral' END AS expected_direction,
           round(least(1.0::DOUBLE, abs(sentiment) * 1.4::DOUBLE + least(hits, 6) * 0.05::DOUBLE)
             * CASE WHEN event IN ('opinion_commentary', 'other') THEN 0.5::DOUBLE ELSE 1 END, 3) AS direction_confidence
         FROM (SELECT *, CASE WHEN event IN {_list(V.MAJOR)} THEN 3 WHEN event IN {_list(V.NOTABLE)} THEN 2
                 WHEN event IN ('other', 'opinion_commentary') THEN CASE WHEN hits >= 3 OR chars > 800 THEN 1 ELSE 0 END ELSE 1 END AS mag
               FROM signed))"""]


@query("n9_n15_lexicon_analysis", B.with_(ARTICLES, *lexicon_sql(CORPUS)) + """
SELECT doc_id, event_type, sentiment, magnitude::INTEGER AS magnitude, is_speculative, is_recap,
       NOT (macro OR event = 'macro') AS is_company_specific, expected_direction, direction_confidence, hits::INTEGER AS n_hits FROM read""",
       "sentiment direction_confidence", direction_confidence=2)
def _(spark, d):
    out = lexicon.analyse(fx.articles(spark, d), CORPUS)
    return out.select("doc_id", "event_type", "sentiment", "magnitude", "is_speculative", "is_recap", "is_company_specific",
                      "expected_direction", "direction_confidence", "n_hits")


@query("n9_n15_default_lexicon", B.with_(ARTICLES, *lexicon_sql(Lexicon())) + """
SELECT doc_id, event_type, sentiment, magnitude::INTEGER AS magnitude, expected_direction, hits::INTEGER AS n_hits FROM read""", "sentiment")
def _(spark, d):
    """The default lists over the same texts, which hold few company words."""
    return lexicon.analyse(fx.articles(spark, d)).select(
        "doc_id", "event_type", "sentiment", "magnitude", "expected_direction", "n_hits")


@query("n16_surprise", """
SELECT event_id, CASE WHEN v[1] IN ('miss', 'below') THEN -try_cast(v[2] AS DOUBLE) ELSE try_cast(v[2] AS DOUBLE) END AS surprise
FROM (SELECT event_id, [regexp_extract(t, p, 1), regexp_extract(t, p, 2)] AS v FROM (
  SELECT event_id, 'profit ' || CASE WHEN event_type = 'error' THEN 'miss' WHEN event_type = 'view' THEN 'below' ELSE 'beat' END
         || ' estimates by ' || CAST(event_id % 900 AS VARCHAR) || '.5 per cent' AS t,
         '(beat|miss|above|below|versus|vs\\.?|against)[^0-9]{0,30}?([0-9]{1,3}(?:\\.[0-9]+)?)\\s*(?:per cent|percent|%)' AS p FROM events))""")
def _(spark, d):
    verb = F.when(F.col("event_type") == "error", "miss").when(F.col("event_type") == "view", "below").otherwise("beat")
    line = F.concat(F.lit("profit "), verb, F.lit(" estimates by "), (F.col("event_id") % 900).cast("string"), F.lit(".5 per cent"))
    return fx.table(spark, d, "events").select("event_id", lexicon.surprise(line).alias("surprise"))


@query("n17_repair", """
SELECT event_id, CASE WHEN event_type = 'buyback' THEN event_type ELSE 'other' END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN 0 ELSE greatest(-1, least(1, value / 30 - 1)) END AS sentiment, greatest(0, least(3, round_even(value / 12, 0)))::INTEGER AS magnitude,
       greatest(-500, least(500, value * 20)) AS numeric_surprise_pct FROM events""", "sentiment numeric_surprise_pct")
def _(spark, d):
    ev = fx.table(spark, d, "events")
    raw = ev.select("event_id", "event_type", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(
        (F.col("value") / 30 - 1).cast("string")).alias("sentiment"), (F.col("value") / 12).alias("magnitude"),
        (F.col("value") * 20).alias("numeric_surprise_pct"))
    return analysis.repair(raw)


KIND = "CASE event_type WHEN 'purchase' THEN 'earnings_beat' WHEN 'view' THEN 'other' WHEN 'signup' THEN 'contract_win' WHEN 'error' THEN 'litigation' WHEN 'click' THEN 'm_and_a_target' END"
SIGN = "CASE event_type WHEN 'view' THEN 0.0::DOUBLE WHEN 'error' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
ANALYSES = f"""
an0 AS (SELECT event_id, 'U' || user_id % 20 AS ticker, ts AS available_at, {KIND} AS event_type,
          {SIGN} * least(value / 100.0, 1.0) AS sentiment, floor(value)::INTEGER % 4 AS magnitude, event_id % 5 = 0 AS is_speculative,
          events.event_type = 'view' AS is_recap, event_id % 7 <> 0 AS is_company_specific,
          CASE WHEN event_id % 11 = 0 THEN value END AS surprise, (event_id % 10) / 10.0::DOUBLE AS novelty FROM events),
an AS (SELECT *, CASE WHEN sentiment > 0.08 THEN 1 WHEN sentiment < -0.08 THEN -1 ELSE 0 END * least(abs(sentiment) * 1.4::DOUBLE, 1)
         * magnitude / 3.0::DOUBLE * CASE WHEN is_speculative THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN is_recap THEN 0.3::DOUBLE ELSE 1 END
         * CASE WHEN NOT is_company_specific THEN 0.4::DOUBLE ELSE 1 END AS signed_score FROM an0)"""


@query("n18_signed_score", B.with_(ANALYSES) + " SELECT event_id, signed_score FROM an", "signed_score")
def _(spark, d):
    return fx.analyses(spark, d).select("event_id", "signed_score")


@query("n19_sentiment_model_merge", B.with_(ANALYSES, """
scored AS (SELECT event_id, sentiment AS old, expected, value / 60 AS score,
             CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END AS label
           FROM (SELECT *, CASE WHEN sentiment > 0.08 THEN 'up' WHEN sentiment < -0.08 THEN 'down' ELSE 'neutral' END AS expected FROM an)
           JOIN (SELECT event_id, value FROM events) USING (event_id)),
toned AS (SELECT *, CASE label WHEN 'positive' THEN score WHEN 'negative' THEN -score WHEN 'neutral' THEN 0 ELSE old END AS s FROM scored)""")
       + """
SELECT event_id, s AS sentiment, CASE WHEN label IS NULL THEN expected WHEN s > 0.15 THEN 'up' WHEN s < -0.15 THEN 'down'
       ELSE 'neutral' END AS expected_direction FROM toned""", "sentiment")
def _(spark, d):
    label = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), (F.col("event_id") % 4 + 1).cast("int"))
    scores = fx.table(spark, d, "events").filter("event_id % 4 < 3").select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"), label.alias("label"), (F.col("value") / 60).alias("score"))
    return analysis.merge_sentiment_model(fx.analyses(spark, d), scores).select("event_id", "sentiment", "expected_direction")


@query("n20_incremental_analysis", B.with_(ARTICLES, f"""
keyed AS (SELECT doc_id, sha256({norm_sql('full_text')}) AS h FROM arts),
done AS (SELECT DISTINCT h FROM keyed WHERE doc_id % 3 = 0)""") + """
SELECT count(*) AS n_keys, 'ok' AS status FROM (SELECT DISTINCT h FROM keyed WHERE h NOT IN (SELECT h FROM done))""")
def _(spark, d):
    """One document in three is on file; the others are analysed once per distinct text."""
    how = {"backend": lexicon.BACKEND, "model_id": lexicon.MODEL_ID}
    arts = fx.articles(spark, d)
    known = arts.filter("doc_id % 3 = 0").select(text.cache_key("content_hash", prompt_version="v1", **how).alias("key")).distinct()
    todo = analysis.pending(arts, known, **how)
    done = analysis.analyse_pending(todo, lexicon.analyse, **how)
    return done.groupBy("status").agg(F.count("*").alias("n_keys"))


@query("n21_analysis_stats", """
SELECT source AS backend, count(*) AS entries, count(*) FILTER (n_chars >= 1000) AS ok, count(*) FILTER (n_chars < 1000) AS failed,
       sum(n_chars * 0.001::DOUBLE) AS spend_usd FROM documents GROUP BY 1""", "spend_usd", 4)
def _(spark, d):
    doc = fx.table(spark, d, "documents").withColumnRenamed("source", "backend")
    table = doc.select("backend", F.when(F.col("n_chars") >= 1000, "ok").otherwise("failed").alias("status"))
    return analysis.analysis_stats(table, doc.select("backend", (F.col("n_chars") * 0.001).alias("usd")))


@query("n22_flatten_records", B.with_(ANALYSES) + """
SELECT ticker, event_type, sentiment, magnitude, signed_score, novelty FROM an""", "sentiment signed_score novelty")
def _(spark, d):
    nested = fx.analyses(spark, d).select(
        "content_hash", "ticker", F.col("available_at").alias("published_at"), F.col("available_at").alias("first_seen_at"),
        F.struct("event_type", "sentiment", "magnitude", "is_speculative", "is_recap", "is_company_specific", "expected_direction",
                 "direction_confidence", "numeric_surprise_pct").alias("analysis"),
        "novelty", F.lit("events").alias("backend"), F.lit("").alias("source"))
    return analysis.flatten_records(nested).select("ticker", "event_type", "sentiment", "magnitude", "signed_score", "novelty")


EVENT_DAYS = """
sessions AS (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events WHERE isodow(ts) <= 5)"""
CUTOFF = "timezone('UTC', timezone('America/New_York', CAST(decision_session AS TIMESTAMP) + INTERVAL 16 HOUR))"


def news_sql(decisions: str) -> list[str]:
    groups = {g: "(" + ", ".join(f"'{m}'" for m in ms) + ")" for g, ms in nf.EVENT_GROUPS.items()}
    return [ANALYSES, EVENT_DAYS, decisions, f"cuts AS (SELECT decision_session, {CUTOFF} AS cut FROM decisions)", """
seen AS (SELECT *, pow(0.5::DOUBLE, (epoch_us(cut) - epoch_us(available_at)) / 3.6e9::DOUBLE / 36.0::DOUBLE)
           * CASE WHEN is_company_specific THEN 1 ELSE 0.3::DOUBLE END * CASE WHEN is_speculative THEN 0.5::DOUBLE ELSE 1 END
           * greatest(0.05::DOUBLE, least(1, novelty)) AS w
         FROM an JOIN cuts ON available_at < cut AND available_at >= cut - INTERVAL 10 DAY)""", f"""
agg AS (SELECT decision_session, cut, ticker,
          CASE WHEN sum(w) <= 1e-9 THEN avg(sentiment) ELSE sum(sentiment * w) / sum(w) END AS news_sentiment_decay,
          CASE WHEN sum(w) <= 1e-9 THEN avg(signed_score) ELSE sum(signed_score * w) / sum(w) END AS news_score_decay,
          max(abs(sentiment)) AS news_sentiment_max_abs, count(*)::DOUBLE AS news_count,
          sum(signed_score * novelty) / count(*) AS news_novelty_weighted, stddev_pop(sentiment) AS news_dispersion,
          max(magnitude)::DOUBLE AS news_max_magnitude, avg(is_speculative::INTEGER) AS news_speculative_frac,
          avg(is_recap::INTEGER) AS news_recap_frac, avg(surprise) AS news_surprise,
          {", ".join(f"sum(CASE WHEN event_type IN {m} THEN signed_score ELSE 0 END) AS news_evt_{g}" for g, m in groups.items())}
        FROM seen GROUP BY ALL)""", """
news AS (SELECT * EXCLUDE (cut), CASE WHEN count(news_count) OVER b >= 6 THEN
           (news_count - avg(news_count) OVER b) / nullif(stddev_samp(news_count) OVER b, 0) END AS news_count_z,
           (epoch_us(cut) - (SELECT epoch_us(max(available_at)) FROM an m WHERE m.ticker = agg.ticker AND magnitude >= 2
              AND NOT is_recap AND m.available_at < agg.cut)) / 86400e6::DOUBLE AS news_days_since_material
         FROM agg WINDOW b AS (PARTITION BY ticker ORDER BY decision_session ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING))"""]


DAILY = "decisions AS (SELECT session AS decision_session FROM sessions)"
NEWS_COLS = ", ".join(nf.FEATURES)


@query("n23_n28_weekly_news", B.with_(*news_sql(B.decisions())) + f" SELECT decision_session, ticker, {NEWS_COLS} FROM news",
       " ".join(nf.FEATURES), 7)
def _(spark, d):
    return nf.build_news_features(fx.analyses(spark, d), cal.all_decisions(cal.sessions(fx.event_sessions(spark, d))))


def daily_news(spark, d):
    grid = fx.event_sessions(spark, d).select(F.col("session").alias("decision_session"),
                                              cal.close_instant(F.col("session")).alias("decision_ts"))
    return nf.build_news_features(fx.analyses(spark, d), grid)


@query("n23_n28_daily_news", B.with_(*news_sql(DAILY)) + f" SELECT decision_session, ticker, {NEWS_COLS} FROM news",
       " ".join(nf.FEATURES), 7)
def _(spark, d):
    return daily_news(spark, d)


@query("n29_news_coverage", B.with_(*news_sql(DAILY), """
panel AS (SELECT session AS decision_session, 'U' || u AS ticker FROM sessions CROSS JOIN (SELECT DISTINCT user_id % 30 AS u FROM events))""")
       + """
SELECT round(count(news_count) / count(*)::DOUBLE, 4) AS coverage, (SELECT count(*) FROM news) AS n_ticker_weeks,
       (SELECT median(news_count) FROM news) AS median_articles FROM panel LEFT JOIN news USING (decision_session, ticker)""",
       "coverage median_articles", 4)
def _(spark, d):
    names = fx.table(spark, d, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 30).cast("string")).alias("ticker"))
    days = fx.event_sessions(spark, d)
    grid = cal.align_panel(names.select("ticker", F.lit(None).cast("date").alias("session")).filter("session is not null"), days, names).withColumnRenamed("session", "decision_session")
    return nf.coverage_report(daily_news(spark, d), grid)
