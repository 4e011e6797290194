"""Default word and pattern lists of the lexicon analyzer. All lists are fixed values; pass others for other domains."""

from dataclasses import dataclass

# Words of positive tone in company news.
POSITIVE = (
    "beat", "beats", "beating", "exceeded", "exceeds", "outperform", "outperformed", "upgrade", "upgraded", "raised", "raises", "surge", "surged", "soar",
    "soared", "jump", "jumped", "rally", "rallied", "gain", "gains", "gained", "rose", "rise", "rising", "profit", "profitable", "record", "strong", "stronger",
    "strength", "robust", "solid", "healthy", "improve", "improved", "improvement", "growth", "grew", "expanding", "expansion", "accelerate", "accelerated",
    "momentum", "win", "wins", "won", "award", "awarded", "secured", "landed", "bagged", "contract", "order", "approval", "approved", "cleared", "clearance",
    "authorised", "authorized", "granted", "licence", "license", "buyback", "repurchase", "dividend", "bonus", "special-dividend", "partnership", "alliance",
    "collaboration", "tie-up", "launch", "launched", "unveil", "unveiled", "breakthrough", "milestone", "successful", "success", "optimistic", "confident",
    "upbeat", "bullish", "turnaround", "recovery", "rebound", "revival", "outperformance", "premium", "up", "higher", "advance", "advances", "buy", "accumulate",
)

# Words of negative tone in company news.
NEGATIVE = (
    "miss", "missed", "missing", "below", "shortfall", "disappoint", "disappointing", "disappointed", "downgrade", "downgraded", "cut", "cuts", "cutting",
    "lowered", "lower", "reduce", "reduced", "slash", "slashed", "fall", "fell", "falling", "drop", "dropped", "decline", "declined", "plunge", "plunged",
    "slump", "slumped", "tumble", "tumbled", "sink", "sank", "crash", "crashed", "weak", "weaker", "weakness", "soft", "softer", "sluggish", "loss", "losses",
    "lossmaking", "deficit", "writedown", "write-off", "impairment", "provision", "debt", "leverage", "default", "insolvency", "bankruptcy", "bankrupt",
    "liquidation", "restructuring", "probe", "investigation", "inquiry", "raid", "fine", "penalty", "sanction", "violation", "breach", "fraud", "lawsuit",
    "litigation", "sue", "sued", "sues", "verdict", "injunction", "recall", "halt", "halted", "suspension", "suspended", "shutdown", "strike", "protest",
    "outage", "disruption", "resign", "resigned", "resignation", "stepping-down", "ouster", "fired", "sacked", "exit", "warning", "warns", "warned", "caution",
    "cautious", "concern", "concerns", "risk", "risks", "headwind", "headwinds", "dilution", "placement", "stake-sale", "offloaded", "pledged", "bearish",
    "pessimistic", "downturn", "slowdown", "contraction", "down", "sell", "underperform", "crack", "cracks", "worry", "worries", "pressure",
)

# Words that strengthen, and words that reverse, a tone word up to four words later.
INTENSIFIERS = ("sharply", "steeply", "significantly", "substantially", "materially", "dramatically", "massive", "huge", "record", "surprisingly", "unexpectedly")
NEGATORS = ("not", "no", "never", "without", "fails", "failed", "unable", "denies", "denied", "refuted")

# Phrases marking rumour, summaries of known news, and macro pieces.
SPECULATIVE = (
    "reportedly", "rumour", "rumor", "in talks", "may ", "might ", "could ", "considering", "exploring", "weighing",
    "is said to", "sources said", "people familiar", "speculation", "potential", "eyeing", "mulling", "plans to",
    "expected to",
)
RECAP = (
    "market wrap", "closing bell", "session highlights", "week in review", "recap", "at a glance", "top gainers",
    "top losers", "sensex", "nifty closed", "stocks to watch", "market close", "midday", "roundup", "here's what",
    "what to know",
)
MACRO = (
    "inflation", "interest rate", "rbi ", "federal reserve", "fed ", "gdp", "budget", "monetary policy", "repo rate",
    "bond yield", "crude oil price", "rupee", "dollar index", "trade war", "tariff", "recession", "unemployment", "cpi", "ppi",
)
OPINION = ("opinion", "view:", "analysis:", "column")

# Phrases of each event type, in order of precedence.
EVENT_PATTERNS = (
    ("m_and_a_target", ("to be acquired", "takeover bid", "acquisition of", "buyout offer", "open offer", "to acquire stake in")),
    ("m_and_a_acquirer", ("acquires", "to acquire", "acquisition", "merger", "buys stake", "amalgamation")),
    ("earnings_beat", ("beats estimate", "beat estimates", "above estimate", "tops estimate", "exceeds expectation", "profit beats")),
    ("earnings_miss", ("misses estimate", "missed estimates", "below estimate", "profit falls", "profit declines",
                       "misses expectation", "net loss")),
    ("earnings_inline", ("in line with estimate", "meets estimate", "matches estimate")),
    ("guidance_up", ("raises guidance", "raises outlook", "hikes forecast", "upgrades guidance", "raises target")),
    ("guidance_down", ("cuts guidance", "lowers outlook", "trims forecast", "warns on", "profit warning", "cuts forecast")),
    ("dividend_change", ("dividend", "interim payout", "final payout")),
    ("buyback", ("buyback", "share repurchase", "repurchase programme", "repurchase program")),
    ("dilution", ("qip", "share sale", "equity raise", "placement", "rights issue", "convertible", "stake sale", "offer for sale")),
    ("regulatory_approval", ("approval", "approved", "cleared by", "gets nod", "receives nod", "clearance", "licence granted")),
    ("regulatory_action", ("sebi", "penalty", "fine of", "probe", "investigation", "show cause", "sanction", "banned", "raid",
                           "notice from")),
    ("litigation", ("lawsuit", "sues", "sued", "litigation", "court", "tribunal", "verdict", "arbitration")),
    ("credit_rating", ("rating", "moody", "fitch", "s&p", "crisil", "icra", "outlook revised")),
    ("analyst_action", ("upgrade", "downgrade", "initiates coverage", "price target", "target price", "brokerage", "rated buy",
                        "rated sell")),
    ("contract_win", ("wins order", "bags order", "wins contract", "secures contract", "awarded", "order worth", "lou",
                      "letter of intent")),
    ("product_launch", ("launches", "unveils", "introduces", "rolls out", "new product", "commissions")),
    ("exec_change", ("ceo", "chief executive", "managing director", "cfo", "chairman", "resigns", "appointed", "steps down")),
    ("operational_disruption", ("fire at", "strike", "shutdown", "outage", "recall", "accident", "explosion", "halt production",
                                "lockout")),
)

# Event types with a direction of their own, and the floor used when wording does not show it.
EVENT_SIGN = {
    "earnings_beat": 1.0, "earnings_miss": -1.0, "guidance_up": 1.0, "guidance_down": -1.0, "regulatory_approval": 1.0,
    "regulatory_action": -1.0, "litigation": -1.0, "operational_disruption": -1.0, "contract_win": 1.0, "buyback": 1.0,
    "dilution": -1.0, "m_and_a_target": 1.0,
}
EVENT_SIGN_FLOOR = 0.55

# Event types that are major (3) or notable (2) by nature; loose ones count by length and wording.
MAJOR = ("m_and_a_target", "m_and_a_acquirer", "guidance_down", "guidance_up", "regulatory_action", "operational_disruption")
NOTABLE = ("earnings_beat", "earnings_miss", "contract_win", "dilution", "regulatory_approval", "litigation", "exec_change",
           "buyback")
LOOSE = ("other", "recap", "opinion_commentary")

# Endings tried, in order, when a word is not listed as it stands.
SUFFIXES = ("s", "es", "ed", "ing", "d")


@dataclass(frozen=True)
class Lexicon:
    positive: tuple = POSITIVE
    negative: tuple = NEGATIVE
    intensifiers: tuple = INTENSIFIERS
    negators: tuple = NEGATORS
    speculative: tuple = SPECULATIVE
    recap: tuple = RECAP
    macro: tuple = MACRO
    opinion: tuple = OPINION
    event_patterns: tuple = EVENT_PATTERNS
    window: int = 4
