"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing outside this package imports it. Each module holds one operator with its own interface; ``queries`` derives the registered
digest queries from them, ``corpus_pipeline`` (top of the repository) chains five of them.
"""
