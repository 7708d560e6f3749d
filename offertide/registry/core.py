from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offertide.functions.numbers import rounded
from offertide.registry.oracle_base import oracle
from offertide.registry.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", extra: str = ""):
    """Register a function of the workspace; doubles are rounded to 6 digits on both sides."""

    def register(build: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(build(workspace(spark, folder)))
        if sql is not None:
            ORACLES[name] = oracle(sql, doubles, extra)
        return build

    return register
