"""The registered queries, by name, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import causal, cleaning, contracts, estimates, features, feeds, findings, forecasts, inference, joins, matching, models, patterns, preflight, ranking, robustness, rollouts, sampling, series, slices, statistics, streams

FLAGSHIP = "profile_orders"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (cleaning, preflight, contracts, findings, inference, joins, matching, statistics, estimates, causal, series, slices, forecasts, patterns, models, features, ranking, robustness, rollouts, sampling, feeds, streams):
    QUERIES |= {name: query for name, (query, _) in _module.QUERIES.items()}
    ORACLE_SQL |= {name: sql for name, (_, sql) in _module.QUERIES.items() if sql}
