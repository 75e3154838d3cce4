"""All queries of the page and deck operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import outputs, queries as operators


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module in (operators, outputs) for name in module.SQL}


def oracle_sql() -> dict[str, str]:
    return {**operators.SQL, **outputs.SQL}
