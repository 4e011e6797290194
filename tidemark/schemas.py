"""Column vocabulary and the StructTypes of the tables the operators exchange."""

from pyspark.sql import types as T

TICKER = "ticker"
SESSION = "session"
DECISION = "decision_session"
DECISION_TS = "decision_ts"
ENTRY = "entry_session"
EXIT = "exit_session"
AVAILABLE_AT = "available_at"
SECTOR = "sector"
LABEL = "label"
T0 = "label_t0"
T1 = "label_t1"
WEIGHT = "sample_weight"
PREDICTION = "prediction"
NEWS_PREFIX = "news_"

PRICES = ("open", "high", "low", "close")

BARS = T.StructType(
    [T.StructField(TICKER, T.StringType()), T.StructField(SESSION, T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume", "split_factor", "div_cash")]
    + [T.StructField(AVAILABLE_AT, T.TimestampType()), T.StructField("is_delisted", T.BooleanType())]
)

ARTICLES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("content_hash", TICKER, "title", "body", "url", "source")]
    + [T.StructField(c, T.TimestampType()) for c in ("published_at", "first_seen_at", AVAILABLE_AT)]
)

ENTITY = T.StructType([T.StructField(TICKER, T.StringType()), T.StructField("role", T.StringType())])

ANALYSIS = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("sentiment", T.DoubleType()),
        T.StructField("magnitude", T.IntegerType()),
        T.StructField("is_speculative", T.BooleanType()),
        T.StructField("is_recap", T.BooleanType()),
        T.StructField("is_company_specific", T.BooleanType()),
        T.StructField("expected_direction", T.StringType()),
        T.StructField("direction_confidence", T.DoubleType()),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("numeric_surprise_pct", T.DoubleType()),
        T.StructField("rationale", T.StringType()),
    ]
)

#: Columns that are keys, labels or bookkeeping and never model inputs.
NOT_FEATURES = frozenset(
    {TICKER, SESSION, DECISION, DECISION_TS, SECTOR, LABEL, ENTRY, EXIT, T0, T1, WEIGHT, "raw_return",
     AVAILABLE_AT, *PRICES, "volume", "split_factor", "div_cash", "is_delisted", "adjustment_factor",
     "adv_notional", "liquid", "n_sessions", "week_end", PREDICTION, "fold", "expected_return"}
)
