"""Registered queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from plantlens.queries import charts, compare, explore, features, models, selection, splits, table, tags
from plantlens.queries.base import Query

ALL: list[Query] = [q for module in (table, selection, compare, explore, features, splits, charts, tags, models)
                    for q in module.QUERIES]
BY_NAME = {q.name: q for q in ALL}
