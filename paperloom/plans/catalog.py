"""Registration of a query together with its oracle."""

from __future__ import annotations


class Catalog:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(call):
            self.queries[name] = call
            if sql:
                self.oracles[name] = sql
            return call

        return add
