"""Names of queries, the functions behind them and their SQL."""

from __future__ import annotations

from lodestar.operators import retrieval, serving, text, urls, warehouse  # noqa: F401
from lodestar.operators.dialect import REGISTRY, Check, run
from lodestar.plans import frames, parsers, tables

flagship = frames.flagship


def queries() -> dict:
    made = {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in REGISTRY}
    return {**made, **frames.QUERIES, **tables.QUERIES, **parsers.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{name: build(Check()) for name, build in REGISTRY.items()}, **frames.oracle(), **tables.SQL, **parsers.SQL}
