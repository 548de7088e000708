"""Operators of a training-data pipeline over ``documents``, ``pages``, ``benchmark`` and ``conversations``.

Each module holds one operator with its general interface, the thin ``opN_`` query over the given tables, and the SQL that
must give the same rows where SQL can express it. ``catalog`` gathers the queries.
"""
