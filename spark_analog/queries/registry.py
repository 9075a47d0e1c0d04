"""Named queries: a Spark callable and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_parts: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: str, text: str) -> None:
    """Register a common table expression and what it reads."""
    _parts[name] = (tuple(needs.split()), text)


def sql(needs: str, body: str) -> str:
    """``body`` preceded by the table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _parts[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body
    return "with " + ",\n".join(
        f"{n} as materialized ({_parts[n][1]})" for n in ordered) + "\n" + body


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def memo(fn):
    """Keep a staged frame per session and folder: many queries start from the same one."""
    def wrapped(spark, sf):
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in _kept:
            _kept[key] = fn(spark, sf)
        return _kept[key]
    return wrapped


def forget() -> None:
    _kept.clear()
