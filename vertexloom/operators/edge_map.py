"""The two dataflow operators: messages along edges, and changes of vertex state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_edges(edges: DataFrame, frontier: DataFrame | None = None, where: Column | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Out-edges of the active sources.

    frontier(id, ...): only sources in it, its other columns joined to each edge. where: a condition on src (and degree).
    start, end: only sources in [start, end). All reach the scan of edges before any join.
    """
    e = edges
    if start is not None:
        e = e.where(F.col("src") >= start)
    if end is not None:
        e = e.where(F.col("src") < end)
    if where is not None:
        e = e.where(where)
    if frontier is not None:
        e = e.join(frontier.withColumnRenamed("id", "src"), "src")
    return e


def combined(messages: DataFrame, combine: Column) -> DataFrame:
    """(id, message): combine for each destination of the given edges, partly before the shuffle by destination."""
    return messages.groupBy(F.col("dst").alias("id")).agg(combine.alias("message"))


def edge_map(edges: DataFrame, combine: Column, frontier: DataFrame | None = None, **active) -> DataFrame:
    """(id, message): combine (an aggregate over src, dst, degree and the frontier's columns) for each destination of an
    active edge. Messages are combined before the shuffle by destination, which is the only one."""
    return combined(active_edges(edges, frontier, **active), combine)


def edge_apply(edges: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, frontier: DataFrame | None = None, **active) -> DataFrame:
    """What function makes of the active edges, for what columns can't express: it gets Arrow batches of the columns of
    active_edges() and gives batches of schema, any number of rows for each edge. Tasks may run again, so it should have no
    effects outside. Results with dst and a message can go on to combined()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (function(batch) for batch in batches)

    return active_edges(edges, frontier, **active).mapInArrow(run, schema)


def vertex_map(state: DataFrame, start: int | None = None, end: int | None = None, **columns: Column) -> DataFrame:
    """state with the given columns anew for ids in [start, end); other vertices keep theirs (null where new)."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("id") >= start)
    if end is not None:
        inside = inside & (F.col("id") < end)
    if start is None and end is None:
        return state.withColumns(columns)
    return state.withColumns({c: F.when(inside, v).otherwise(F.col(c) if c in state.columns else F.lit(None)) for c, v in columns.items()})
