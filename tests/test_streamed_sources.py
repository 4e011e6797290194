"""Streamed sources are written by as many tasks as they have."""

import inspect

from tidemark.plans.catalog import load


def test_streamed_sources_are_not_written_by_few_tasks():
    for name in ("r1_streamed_articles", "r2_streamed_bars"):
        source = inspect.getsource(inspect.getclosurevars(load().QUERIES[name]).nonlocals["fn"])
        assert "coalesce(" not in source
