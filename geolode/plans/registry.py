"""All queries of the point-cloud operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolode.plans.tables import POINTS_SQL, LasTables, Tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_BUILDS: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name; sql may use the views pts, ch, tiles, world, loc and chl, and begin with further ones."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        _BUILDS[name] = build
        if sql is not None:
            more, body = sql.split(";;") if ";;" in sql else ("", sql)
            _SQL[name] = f"WITH {POINTS_SQL}{', ' + more if more else ''} {body}"
        return build

    return add


def number(value: float) -> str:
    """A double as SQL text."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["lod_route"](spark, sf_dir)


def _load() -> None:
    from geolode.plans import aggregations, details, geometry, incremental, joins, projections, scans, views  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def on_files(name: str, spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A query that needs points, chunk points, tiles or patches, over a folder of LAS files."""
    _load()
    return _BUILDS[name](LasTables(spark, folder, **options))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
