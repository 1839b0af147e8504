"""Queries and oracle SQL by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.operators.components import subgraphs
from strandlake.plans import calls, placement, placement_calls, sequence_calls, sequences, statistics, structure, structure_calls  # noqa: F401 (the calls modules add to calls)
from strandlake.plans.assembly import Assembly
from strandlake.plans.model import with_views
from strandlake.sources import exchange

SQL: dict[str, str] = placement.SQL | statistics.SQL | sequences.SQL | structure.SQL

_ENOUGH = 2
_BRIDGED = f"""with recursive {structure._BRIDGES}, e as (select a, b from br where templates>={_ENOUGH} union select b, a from br where templates>={_ENOUGH}),
    go(a, b) as (select a, a from e union select go.a, e.b from go join e on e.a=go.b)
  select a as contig_id, min(b) as seed from go group by a"""


def result(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Assembly(spark, sf_dir).sql(sql)


def runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: result(spark, sf_dir, sql)


def caller(query: Callable[[Assembly], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Assembly(spark, sf_dir))


def bridge_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig_id, seed: contigs held together by bridges of two templates or more, for all seeds at once."""
    return subgraphs(QUERIES["bridges"](spark, sf_dir), _ENOUGH)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(sql) for name, sql in SQL.items()}
QUERIES |= exchange.trips(result) | {"bridge_subgraph": bridge_subgraph} | {name: caller(query) for name, query in calls.CALLS.items()}
ORACLES: dict[str, str] = {name: with_views(sql, duck=True) for name, sql in SQL.items()}
#: Greedy chains, which SQL can't state; tests hold them against plain Python.
CHAINS = {"scaffolds", "scaffold_layout", "superscaffolds", "sink_scaffold_tree", "sink_agp"}
ORACLES |= exchange.ORACLES | {"bridge_subgraph": with_views(_BRIDGED, duck=True)} | {name: with_views(sql, duck=True) for name, sql in calls.DUCK.items()}
ORACLES = {name: sql for name, sql in ORACLES.items() if name not in CHAINS}
