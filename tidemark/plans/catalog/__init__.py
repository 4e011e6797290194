"""The registered queries, one module per area."""

from importlib import import_module

AREAS = ("bars_queries", "feature_queries", "news_queries", "money_queries", "source_queries", "evaluation_queries", "model_queries", "record_queries")


def load():
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return import_module(f"{__name__}.registry")
