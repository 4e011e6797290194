"""Named queries over the given tables, each with the SQL that must give the same rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import prepare

QUERIES: dict = {}
ORACLES: dict = {}


def _digits(doubles: str, digits: int, override: dict) -> dict:
    return {name: override.get(name, digits) for name in doubles.split()}


def rounded(df: DataFrame, digits: dict) -> DataFrame:
    """Round the named doubles; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in digits.items()})


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6, **override: int):
    """Register ``fn(spark, sf_dir)``; the named double columns are rounded alike on both sides."""
    places = _digits(doubles, digits, override)

    def wrap(fn):
        def run(spark, sf_dir):
            return rounded(fn(prepare(spark), sf_dir), places)

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            replace = ", ".join(f'round(CAST("{c}" AS DOUBLE), {n}) + 0.0::DOUBLE AS "{c}"' for c, n in places.items())
            ORACLES[name] = f"SELECT * REPLACE ({replace}) FROM ({sql})" if places else sql
        return fn

    return wrap
