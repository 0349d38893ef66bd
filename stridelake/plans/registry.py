"""All registered queries of the library outside llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register the function (spark, sf_dir) -> DataFrame under the name, with the DuckDB SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    from stridelake.plans import activities, daily, ingest, scalars, stops, streams  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
