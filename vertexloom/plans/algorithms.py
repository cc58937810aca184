"""Breadth-first search, k-core, connected components and PageRank over edge_map and vertex_map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.edge_map import combined
from vertexloom.plans.fixpoint import iterate

#: Damping, threshold and number of top vertices.
ALPHA, EPSILON, TOP = 0.85, 0.001, 20


def _received(state: DataFrame, messages: DataFrame) -> DataFrame:
    """state with `message`, null where none came. state is partitioned by id already; only messages move."""
    return state.join(messages, "id", "left")


def _alike(graph: Graph, df: DataFrame) -> DataFrame:
    return df.repartition(graph.partitions, "id")


def bfs(graph: Graph, start: int) -> DataFrame:
    """(id, distance, parent) along out-edges; null where start doesn't reach. Of several parents the smallest id; the
    start's is itself. Raises ValueError if start isn't a vertex."""
    if not 0 <= start < graph.num_vertices:
        raise ValueError(f"start {start} isn't in [0, {graph.num_vertices})")
    at_start = F.col("id") == start
    state = graph.vertices().select("id", F.when(at_start, 0).cast("int").alias("distance"), F.when(at_start, F.col("id")).alias("parent"), at_start.alias("active"))

    def step(s: DataFrame, rounds: int) -> DataFrame:
        sent = combined(graph.out_edges(s.where("active").select("id")), F.min("src"))
        new = F.col("distance").isNull() & F.col("message").isNotNull()
        return _received(s, sent).select("id", F.when(new, rounds + 1).otherwise(F.col("distance")).cast("int").alias("distance"), F.when(new, F.col("message")).otherwise(F.col("parent")).alias("parent"), new.alias("active"))

    return iterate(state, step, graph.num_vertices + 1)[0].select("id", "distance", "parent")


def bfs_summary(levels: DataFrame) -> DataFrame:
    return levels.agg(F.max("distance").alias("max_distance"))


def kcore(graph: Graph, k: int) -> DataFrame:
    """(id, degree) after peeling vertices of degree below k; members are those with degree >= k. By out-degrees, so on
    symmetric graphs it is the k-core; on directed ones degrees may fall below 0, they don't wrap around."""
    state = graph.out_degrees().select("id", "degree", (F.col("degree") < k).alias("active"))

    def step(s: DataFrame, rounds: int) -> DataFrame:
        sent = combined(graph.out_edges(s.where("active").select("id")), F.count("*"))
        left = F.col("degree") - F.coalesce("message", F.lit(0))
        return _received(s, sent).select("id", left.alias("degree"), ((F.col("degree") >= k) & (left < k)).alias("active"))

    return iterate(_alike(graph, state), step, graph.num_vertices + 1)[0].select("id", "degree")


def kcore_members(peeled: DataFrame, k: int) -> DataFrame:
    return peeled.where(F.col("degree") >= k).select("id")


def kcore_summary(peeled: DataFrame, k: int) -> DataFrame:
    return peeled.agg(F.count_if(F.col("degree") >= k).alias("kth_core_membership"))


def components(graph: Graph, weak: bool = False) -> DataFrame:
    """(id, label): the smallest id that reaches a vertex along edges; on symmetric graphs the connected component.
    weak: edges count in both directions."""
    g = graph.make_undirected() if weak else graph
    state = g.vertices().select("id", F.col("id").alias("label"), F.lit(True).alias("active"))

    def step(s: DataFrame, rounds: int) -> DataFrame:
        sent = combined(g.out_edges(s.where("active").select("id", "label")), F.min("label"))
        low = F.coalesce(F.col("message") < F.col("label"), F.lit(False))
        return _received(s, sent).select("id", F.when(low, F.col("message")).otherwise(F.col("label")).alias("label"), low.alias("active"))

    return iterate(state, step, g.num_vertices + 1)[0].select("id", "label")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def components_summary(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).agg(F.count("*").alias("components"), F.count_if(F.col("size") > 1).alias("non_trivial_components"), F.max("size").alias("largest_component_size"))


def pagerank(graph: Graph, most: int = 1000) -> tuple[DataFrame, int]:
    """((id, value), iterations) of delta PageRank, not normalised.

    All vertices begin active with value 0 and delta 1 - ALPHA. In a round each active vertex sends delta * ALPHA /
    degree along its out-edges; what arrives adds to the residual; where its size exceeds EPSILON the residual goes into
    the value, becomes the next delta, and the vertex is active. What stays below is kept and never enters the value.
    Rounds are counted with the last one, which activates nothing.
    """
    state = graph.vertices().select("id", F.lit(0.0).alias("value"), F.lit(1.0 - ALPHA).alias("delta"), F.lit(0.0).alias("residual"), F.lit(True).alias("active"))

    def step(s: DataFrame, rounds: int) -> DataFrame:
        sent = combined(graph.out_edges(s.where("active").select("id", "delta")), F.sum(F.col("delta") * ALPHA / F.col("degree")))
        r = F.col("residual") + F.coalesce("message", F.lit(0.0))
        over = F.abs(r) > EPSILON
        return _received(s, sent).select("id", F.when(over, F.col("value") + r).otherwise(F.col("value")).alias("value"), F.when(over, r).otherwise(F.col("delta")).alias("delta"), F.when(over, 0.0).otherwise(r).alias("residual"), over.alias("active"))

    out, rounds = iterate(state, step, most)
    return out.select("id", "value"), rounds


def top(values: DataFrame, n: int = TOP) -> DataFrame:
    """The n vertices of the largest value; among equal values the larger id first."""
    return values.orderBy(F.desc("value"), F.desc("id")).limit(n)
