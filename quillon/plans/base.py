"""What the query modules share: registration, rounding, and the projections as functions and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon import fixtures as X


def catalogue() -> tuple[dict, Callable]:
    """An empty catalogue and the decorator that registers a query in it under its function's name, with its SQL."""
    plans: dict = {}

    def plan(sql: str | None):
        def put(f):
            plans[f.__name__] = (f, sql)
            return f

        return put

    return plans, plan


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n},6) as {n}" for n in names)


def on(sql: str):
    return lambda spark, d: X.project(spark, d, sql)


def ctes(**named: str) -> str:
    return ", ".join(f"{name} as ({sql})" for name, sql in named.items())
