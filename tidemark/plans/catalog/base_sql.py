"""Common table expressions the oracle statements start from."""

BARS = """
bars AS (
  SELECT 'S' || l_suppkey AS ticker, l_suppkey,
         DATE '2000-01-03' + CAST((k // 5) * 7 + k % 5 AS INTEGER) AS session,
         arg_min(price, ord) AS "open", max(price) AS high, min(price) AS low, arg_max(price, ord) AS "close",
         sum(l_quantity) AS volume,
         CASE WHEN k % 97 = 50 AND l_suppkey % 10 = 3 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS split_factor,
         CASE WHEN k % 13 = 0 THEN arg_max(price, ord) * 0.01::DOUBLE ELSE 0.0::DOUBLE END AS div_cash,
         CAST(DATE '2000-01-03' + CAST((k // 5) * 7 + k % 5 AS INTEGER) AS TIMESTAMP) + INTERVAL 21 HOUR AS available_at,
         FALSE AS is_delisted
  FROM (SELECT *, CAST(floor(datediff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS k,
               l_extendedprice / l_quantity AS price,
               (l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS ord
        FROM lineitem)
  GROUP BY l_suppkey, k
)"""

SESSIONS = """
sessions AS (SELECT session, row_number() OVER (ORDER BY session) AS position FROM (SELECT DISTINCT session FROM bars))"""


def decisions(weekday: int = 4, source: str = "sessions", name: str = "decisions") -> str:
    return f"""
{name} AS (
  SELECT max(session) AS decision_session FROM {source} WHERE isodow(session) - 1 <= {weekday}
  GROUP BY isoyear(session), weekofyear(session)
)"""


def grid(hold: int = 5) -> str:
    return f"""
placed AS (
  SELECT session, lead(session, 1) OVER (ORDER BY session) AS entry_session,
         lead(session, {1 + hold}) OVER (ORDER BY session) AS exit_session FROM sessions
),
grid AS (
  SELECT decision_session, entry_session, exit_session FROM decisions JOIN placed ON session = decision_session
  WHERE entry_session IS NOT NULL AND exit_session IS NOT NULL
)"""


MEMBERSHIP = """
universe AS (
  SELECT 'S' || s_suppkey AS ticker, s_name AS name, n_name AS sector,
         DATE '2000-01-03' + CAST(s_suppkey % 90 AS INTEGER) AS start_date,
         CASE WHEN s_suppkey % 10 = 0 THEN DATE '2000-12-01' + CAST(s_suppkey % 60 AS INTEGER) END AS end_date,
         CASE WHEN s_suppkey % 20 = 0 THEN -0.5::DOUBLE END AS delisting_return,
         CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 7 * 25)::DOUBLE END AS lot_size,
         s_suppkey AS file_order
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


PANEL_BASE = with_(BARS, SESSIONS, decisions(), grid())
