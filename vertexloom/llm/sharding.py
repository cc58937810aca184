"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The ring has 2^63 places; arc k of A arcs covers the places whose top bits, scaled, give k.
RING = 2**63


@dataclass(frozen=True)
class Ring:
    """shards * vnodes virtual nodes at hashed places. arcs: the ring is cut into so many equal arcs, each served by
    the virtual node that follows it. slack: a shard holds at most (1 + slack) of the mean load, plus one document for
    each of its pieces."""

    shards: int = 40
    vnodes: int = 48
    arcs: int = 1 << 14
    slack: float = 0.01

    def owners(self) -> list[int]:
        """The shard of each arc, clockwise: that of the first virtual node at or after the arc's start."""
        nodes = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16) / 16**15, s) for s in range(self.shards) for v in range(self.vnodes))
        out, k = [], 0
        for a in range(self.arcs):
            while k < len(nodes) and nodes[k][0] < a / self.arcs:
                k += 1
            out.append(nodes[k % len(nodes)][1])
        return out


def pieces(ring: Ring, loads: dict[int, int]) -> list[tuple[int, int, int]]:
    """Fills the shards: (arc, from, shard), the arc's load from that offset on, up to its next piece, goes to shard.

    Each arc's keys go to its owner until that is full; what overflows continues clockwise to the next arc's owner that
    isn't. Work and result depend on the number of arcs and shards only, not on the keys.
    """
    owner, left = ring.owners(), {s: int(sum(loads.values()) * (1 + ring.slack) / ring.shards) + 1 for s in range(ring.shards)}
    out = []
    for arc in sorted(loads):
        at, load, k = 0, loads[arc], arc
        while at < load:
            for _ in range(ring.arcs):
                if left[owner[k % ring.arcs]] > 0:
                    break
                k += 1
            shard = owner[k % ring.arcs]
            take = min(load - at, left[shard])
            out.append((arc, at, shard))
            left[shard] -= take
            at += take
    return out


def shard(docs: DataFrame, ring: Ring = Ring(), id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot) for every row of docs, near-equal bytes in each shard.

    size: UTF-8 bytes of the text (null: none) plus overhead. A key is the id with the text's checksum, so that rows
    without an id, or with a repeated one, spread; rows that are equal in both are interchangeable. Null texts have
    crc32 0, as the empty text. Extra columns are ignored; an empty table gives no rows.
    Per arc there is one window; its load is about 1/arcs of all, as ids are hashed. Only the loads of the arcs (at most
    ring.arcs rows) reach the driver, and only its pieces (at most arcs + shards, each with one row) are broadcast.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit(RING - 1))
    keyed = base.withColumn("place", place).withColumn("arc", F.floor(F.col("place") / F.lit(RING // ring.arcs)).cast("int"))
    keyed = keyed.withColumn("arc", F.least("arc", F.lit(ring.arcs - 1)))
    loads = {r.arc: r.load for r in keyed.groupBy("arc").agg(F.sum("size").alias("load")).collect()}
    found = pieces(ring, loads)
    schema = "array<struct<arc:int,cuts:array<bigint>,shards:array<int>>>"
    by_arc: dict[int, list] = {}
    for arc, at, s in found:
        by_arc.setdefault(arc, []).append((at, s))
    literal = json.dumps([{"arc": a, "cuts": [x[0] for x in v], "shards": [x[1] for x in v]} for a, v in by_arc.items()])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(literal), schema)))
    in_arc = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")
    run = keyed.withColumn("before", F.sum("size").over(in_arc) - F.col("size")).withColumn("rank", F.row_number().over(in_arc))
    # the last piece that starts at or before the key's own start
    piece = F.size(F.filter("cuts", lambda c: c <= F.col("before")))
    placed = run.join(F.broadcast(plan), "arc").withColumn("piece", piece).withColumn("shard", F.element_at("shards", F.col("piece"))).drop("cuts", "shards")
    counts = placed.groupBy("shard", "arc", "piece").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    offset = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("arc", "piece")) - F.col("n")).select("arc", "piece", "base", "first")
    out = placed.join(F.broadcast(offset), ["arc", "piece"])  # at most arcs + shards rows
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"))


def shard_query(docs: DataFrame) -> DataFrame:
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
