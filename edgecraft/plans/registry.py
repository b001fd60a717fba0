"""Registry of named queries (one per operator) and their DuckDB oracles.

``@query(name, sql)`` registers a ``(spark, sf_dir) -> DataFrame`` callable;
the registered wrapper rounds double columns to 6 decimals so results compare
across engines.  ``sql=None`` marks an operator without an SQL oracle (model
fits, sequential folds); the driver then checks rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgecraft.functions.exprs import round_doubles
from edgecraft.session import reach_workers

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def _double_round(sql: str, digits: int = 6) -> str:
    """Rewrite every ``round(x, 6)`` into the same two-step IEEE rounding
    the Spark side applies (``edgecraft.functions.exprs.stable_round``)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        cut = inner.rfind(",")
        if cut > 0 and inner[cut + 1:].strip() == str(digits):
            arg = _double_round(inner[:cut], digits)
            sd = f"1e{digits}"
            out.append(sql[i:j] + f"(floor(floor(CAST(({arg}) AS DOUBLE) * 1e9 + 0.5) / 1e9 * {sd} + 0.5) / {sd})")
        else:
            out.append(sql[i:j] + key + _double_round(inner, digits) + ")")
        i = k


def query(name: str, sql: str | None = None, digits: int = 6):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach_workers(spark)
            return round_doubles(fn(spark, sf_dir), digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = _double_round(sql, digits)
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # importing the modules registers their queries
    from edgecraft.plans import queries_core, queries_graph, queries_misc, queries_scoring  # noqa: F401
