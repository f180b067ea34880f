"""How plan modules register queries and their SQL."""

from __future__ import annotations


def registry():
    queries, sql = {}, {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
