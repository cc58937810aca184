"""Directed multigraphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.plans.shared import checkpointed

#: Ids lie in [0, 2^32 - 2]; 2^32 - 1 is reserved for "no vertex" in the binary formats.
MAX_ID = 2**32 - 2


@dataclass(frozen=True)
class Graph:
    """edges(src, dst): a multiset. Vertices are all ids from 0 to the largest one in an edge, isolated ones too."""

    edges: DataFrame
    num_vertices: int

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        """Raises ValueError for an empty edge list, and for ids that are null or outside [0, MAX_ID]."""
        # a cast to the same type would be renamed away above the shuffle, and loops would not know their partitioning
        e = edges.select(*[c if dict(edges.dtypes)[c] == "bigint" else F.col(c).cast("long").alias(c) for c in ("src", "dst")])
        s = e.agg(F.min(F.least("src", "dst")).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls")).first()
        if s.nulls:
            raise ValueError(f"{s.nulls} edges have a null end")
        if s.hi is None:
            raise ValueError("a graph without edges has no vertices")
        if s.lo < 0 or s.hi > MAX_ID:
            raise ValueError(f"ids from {s.lo} to {s.hi} aren't in [0, {MAX_ID}]")
        return cls(e, s.hi + 1)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def make_undirected(self) -> Graph:
        """Every edge and its reverse; self-loops are doubled, nothing is removed."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.edges.unionByName(back), self.num_vertices)

    def vertices(self) -> DataFrame:
        """(id) of all vertices, partitioned by id as loops need it."""
        return self.spark.range(self.num_vertices).repartition(self.partitions, "id")

    def out_degrees(self) -> DataFrame:
        """(id, degree) of all vertices, copies of edges counted, 0 without out-edges."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices().join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def max_out_degree(self) -> DataFrame:
        n = self.edges.groupBy("src").agg(F.count("*").alias("n"))
        return n.agg(F.max("n").alias("max_out_degree"))

    def with_degree(self) -> DataFrame:
        """(src, dst, degree): each edge with its source's out-degree. Edges and degrees are partitioned by src once."""
        d = self.edges.groupBy("src").agg(F.count("*").alias("degree"))
        return self.edges.join(d, "src").select("src", "dst", "degree")

    @cached_property
    def hubs(self) -> DataFrame:
        """(src, spread) of sources with more edges than an even share of a partition: fewer than there are partitions.
        Their edges go to `spread` places each."""
        d = self.edges.groupBy("src").agg(F.count("*").alias("degree"))
        share = max(1, self.edges.count() // self.partitions)
        hot = d.where(F.col("degree") > share).select("src", F.ceil(F.col("degree") / share).cast("int").alias("spread"))
        return checkpointed(hot)

    @cached_property
    def prepared(self) -> DataFrame:
        """with_degree() written once to the shared folder, partitioned by src and sorted in its partitions: rounds of a
        loop read it as it lies, from memory where it fits. What is lost there is read from the folder again."""
        e = self.edges.repartition(self.partitions, "src")
        d = e.groupBy("src").agg(F.count("*").alias("degree"))
        return checkpointed(e.join(d, "src").select("src", "dst", "degree").sortWithinPartitions("src")).persist()

    @cached_property
    def spread(self) -> DataFrame:
        """As prepared, for graphs with hubs: (src, place, dst, degree), partitioned by src and place."""
        at = F.pmod(F.xxhash64("dst"), F.coalesce("spread", F.lit(1)).cast("long")).cast("int")
        e = self.with_degree().join(F.broadcast(self.hubs), "src", "left")  # fewer rows than partitions
        e = e.select("src", at.alias("place"), "dst", "degree")
        return checkpointed(e.repartition(self.partitions, "src", "place").sortWithinPartitions("src", "place")).persist()

    def unpersist(self) -> None:
        """Frees the memory that prepared edges take; they are read from the shared folder from then on."""
        for name in ("prepared", "spread"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def has_hubs(self) -> bool:
        return not self.hubs.isEmpty()

    def out_edges(self, frontier: DataFrame) -> DataFrame:
        """Edges (src, dst, degree) of the sources in frontier(id, ...), with its other columns, for the rounds of a loop.

        Edges stay where they are. Without hubs the frontier, partitioned by id, does so too; with hubs its rows move, those
        of a hub to each of its places, so that no task reads a hub's edges alone.
        """
        f = frontier.withColumnRenamed("id", "src")
        if not self.has_hubs:
            return self.prepared.join(f, "src")
        f = f.join(F.broadcast(self.hubs), "src", "left")
        f = f.withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")
        return self.spread.join(f, ["src", "place"]).drop("place")
