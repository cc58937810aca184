"""The registered graph queries over graphs derived from the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions import codec
from vertexloom.graph import Graph
from vertexloom.operators import frontier
from vertexloom.operators.edge_map import active_edges, edge_map, vertex_map
from vertexloom.plans import algorithms as alg
from vertexloom.plans.shared import shared_dir, written
from vertexloom.sources import csr, edgelist

#: The least degree inside the core that the k-core queries look for: some, but not all, vertices are peeled off.
CORE = 22

# -- graphs ------------------------------------------------------------------------------------------------------------


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def cust_part_edges(s: SparkSession, d: str) -> DataFrame:
    """Customers (even ids) to the parts they ordered (odd ids), an edge for each line item."""
    o = _table(s, d, "orders").select("o_orderkey", "o_custkey")
    return _table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))


def supp_chain_edges(s: SparkSession, d: str) -> DataFrame:
    """From supplier to supplier of consecutive line items of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    return _table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst")).where("dst is not null")


def cust_part(s: SparkSession, d: str) -> Graph:
    return Graph.from_edges(written(cust_part_edges(s, d), "edges"))


def supp_chain(s: SparkSession, d: str) -> Graph:
    return Graph.from_edges(written(supp_chain_edges(s, d), "edges"))


_CUST_PART = "SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_CHAIN = """SELECT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL"""


def _with(edges: str, body: str, sym: bool = False, recursive: str = "") -> str:
    """SQL with e(src, dst), deg(id, degree) of sources, v(id) and vd(id, degree) of all vertices."""
    e = f"SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0" if sym else "SELECT src, dst FROM e0"  # noqa: F541
    return f"""WITH {'RECURSIVE ' * bool(recursive)}e0 AS MATERIALIZED ({edges}), e AS MATERIALIZED ({e}),
deg AS MATERIALIZED (SELECT src AS id, count(*)::BIGINT AS degree FROM e GROUP BY src),
v AS MATERIALIZED (SELECT range::BIGINT AS id FROM range(0, (SELECT max(greatest(src, dst)) + 1 FROM e)::BIGINT)),
vd AS MATERIALIZED (SELECT v.id, coalesce(degree, 0)::BIGINT AS degree FROM v LEFT JOIN deg ON v.id = deg.id){', ' + recursive if recursive else ''}
{body}"""


def _rounds(columns: str, first: str, message: str, update: str) -> str:
    """A recursive table r(id, columns, act, it) with a row for each vertex and round, until nothing is active."""
    return f"""r(id, {columns}, act, it) AS ({first} UNION ALL
SELECT * FROM (SELECT {update} FROM r LEFT JOIN (SELECT e.dst AS id, {message} AS m FROM r a JOIN e ON a.id = e.src JOIN deg ON deg.id = e.src
WHERE a.act GROUP BY e.dst) x ON r.id = x.id) WHERE EXISTS (SELECT 1 FROM r y WHERE y.act)),
done AS (SELECT * FROM r WHERE it = (SELECT max(it) FROM r))"""


_BFS = _rounds("distance, parent", "SELECT id, CASE WHEN id = 0 THEN 0 END::INTEGER, CASE WHEN id = 0 THEN id END, id = 0, 0 FROM v", "min(e.src)",
               "r.id, CASE WHEN distance IS NULL AND m IS NOT NULL THEN it + 1 ELSE distance END::INTEGER, CASE WHEN distance IS NULL AND m IS NOT NULL THEN m ELSE parent END, distance IS NULL AND m IS NOT NULL, it + 1")
_CC = _rounds("label", "SELECT id, id, true, 0 FROM v", "min(a.label)", "r.id, least(label, coalesce(m, label)), coalesce(m < label, false), it + 1")
_CORE = _rounds("degree", f"SELECT id, degree, degree < {CORE}, 0 FROM vd", "count(*)::BIGINT", f"r.id, degree - coalesce(m, 0), degree >= {CORE} AND degree - coalesce(m, 0) < {CORE}, it + 1")
_RANK = _rounds("value, delta, residual", "SELECT id, 0.0::DOUBLE, 1.0::DOUBLE - 0.85::DOUBLE, 0.0::DOUBLE, true, 0 FROM v", "sum(a.delta * 0.85::DOUBLE / deg.degree)",
                """r.id, CASE WHEN abs(residual + coalesce(m, 0.0::DOUBLE)) > 0.001::DOUBLE THEN value + residual + coalesce(m, 0.0::DOUBLE) ELSE value END,
CASE WHEN abs(residual + coalesce(m, 0.0::DOUBLE)) > 0.001::DOUBLE THEN residual + coalesce(m, 0.0::DOUBLE) ELSE delta END,
CASE WHEN abs(residual + coalesce(m, 0.0::DOUBLE)) > 0.001::DOUBLE THEN 0.0::DOUBLE ELSE residual + coalesce(m, 0.0::DOUBLE) END,
abs(residual + coalesce(m, 0.0::DOUBLE)) > 0.001::DOUBLE, it + 1""")

# -- queries -----------------------------------------------------------------------------------------------------------


def busy(g: Graph) -> DataFrame:
    """The frontier of vertices with more than 30 out-edges."""
    return frontier.of(g.out_degrees(), F.col("degree") > 30)


def _hub_edges(s: SparkSession, d: str) -> DataFrame:
    return active_edges(cust_part(s, d).with_degree(), where=F.col("degree") > 30).select("src", "dst")


def _edge_map(s: SparkSession, d: str, half: bool) -> DataFrame:
    g = cust_part(s, d).make_undirected()
    ends = {"start": 0, "end": g.num_vertices // 2} if half else {}
    got = edge_map(g.edges, F.count("*"), frontier.members(busy(g)), **ends)
    return got.select(F.col("id").alias("dst"), F.col("message").alias("messages"))


def _vertex_map(s: SparkSession, d: str, half: bool) -> DataFrame:
    g = cust_part(s, d)
    state = g.out_degrees().withColumn("value", F.lit(0).cast("long"))
    ends = {"start": 0, "end": g.num_vertices // 2} if half else {}
    return vertex_map(state, value=F.col("degree") * 2 + F.col("id"), **ends).select("id", "value")


def _union(s: SparkSession, d: str) -> DataFrame:
    g = cust_part(s, d)
    into = g.edges.groupBy(F.col("dst").alias("id")).count()
    return frontier.union(busy(g), frontier.of(into, F.col("count") > 30))


def _bitmap(s: SparkSession, d: str) -> DataFrame:
    return frontier.bitmap(busy(cust_part(s, d))).select("bucket", F.bitmap_count("bits").alias("set_bits"))


def _frontier_from_bitmap(s: SparkSession, d: str) -> DataFrame:
    return frontier.from_bitmap(frontier.bitmap(busy(cust_part(s, d))))


def _bfs(s: SparkSession, d: str) -> DataFrame:
    return alg.bfs(supp_chain(s, d), 0)


def _peeled(s: SparkSession, d: str) -> DataFrame:
    return alg.kcore(cust_part(s, d).make_undirected(), CORE)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return alg.components(cust_part(s, d).make_undirected())


def _rank(s: SparkSession, d: str, chain: bool) -> tuple[DataFrame, int]:
    return alg.pagerank(supp_chain(s, d) if chain else cust_part(s, d).make_undirected())


def _rounded(values: DataFrame) -> DataFrame:
    return values.select("id", F.round("value", 6).alias("value"))


def _iterations(s: SparkSession, d: str, chain: bool) -> DataFrame:
    return s.range(1).select(F.lit(_rank(s, d, chain)[1]).cast("long").alias("iterations"))


def _sorted(s: SparkSession, d: str) -> DataFrame:
    """Edges in order with their place: ranks within blocks of sources and sums over the blocks, not one window."""
    e = supp_chain_edges(s, d)
    block = F.expr("src div 1024")
    base = e.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    base = base.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    at = F.row_number().over(Window.partitionBy("block").orderBy("src", "dst"))
    return e.withColumn("block", block).withColumn("at", at).join(base, "block").select((F.col("base") + F.col("at")).alias("rn"), "src", "dst").orderBy("src", "dst")


def _neighbors(s: SparkSession, d: str) -> DataFrame:
    return cust_part_edges(s, d).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def _block_pack(s: SparkSession, d: str) -> DataFrame:
    """Headers for the neighbour counts and the widths of the largest deltas, packed and unpacked."""
    n = _neighbors(s, d).select(F.size("neighbors").cast("long").alias("num_vals"), codec.delta_width(F.array_max(F.expr("transform(sequence(1, size(neighbors)), i -> neighbors[i - 1] - coalesce(get(neighbors, i - 2), neighbors[i - 1]))"))).alias("delta_size"))
    p = n.distinct().withColumn("packed", codec.pack(F.col("num_vals"), F.col("delta_size")))
    return p.select("num_vals", "delta_size", "packed", codec.unpack_num_vals(F.col("packed")).alias("unpacked_num_vals"), codec.unpack_delta_size(F.col("packed")).alias("unpacked_delta_size"))


def _width_hist(s: SparkSession, d: str) -> DataFrame:
    e = cust_part_edges(s, d)
    delta = F.col("dst") - F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    return e.select(delta.alias("delta")).where("delta is not null").groupBy(codec.delta_width(F.col("delta")).alias("delta_width")).agg(F.count("*").alias("n"))


def _compressed(s: SparkSession, d: str) -> DataFrame:
    return _neighbors(s, d).select("src", F.size("neighbors").cast("long").alias("degree"), codec.compress_column("neighbors").alias("list"))


def _codec_stats(s: SparkSession, d: str) -> DataFrame:
    return _compressed(s, d).select("src", "degree", F.size("list").cast("long").alias("words"))


def _codec_roundtrip(s: SparkSession, d: str) -> DataFrame:
    return _compressed(s, d).select("src", F.explode(codec.decompress_column("list")).alias("dst"))


def _csr(s: SparkSession, d: str, kind: str) -> DataFrame:
    path = f"{shared_dir(s)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(supp_chain(s, d) if kind == "raw" else cust_part(s, d), path, kind)
    return csr.read_csr(s, path)


def _csr_bfs(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Breadth-first search over a graph opened from its files; edges of every line item."""
    path = f"{shared_dir(s)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(supp_chain(s, d), path, kind)
    return alg.bfs(csr.open_graph(s, path), 0).select("id", "distance")


def _csr_frontier(s: SparkSession, d: str) -> DataFrame:
    """Messages of the vertices of one id in 64 that have out-edges, from the blocks of the files that hold them."""
    path = f"{shared_dir(s)}/csr-{uuid.uuid4().hex}"
    g = cust_part(s, d)
    csr.write_csr(g, path, "delta")
    active = g.out_degrees().where("id % 64 = 0 and degree > 0").select("id")
    return edge_map(csr.active_edges(s, path, active, 64), F.count("*")).select(F.col("id").alias("dst"), F.col("message").alias("messages"))


def _csr_degrees(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(cust_part(s, d), path, "delta")
    return csr.read_degrees(s, path)


def _text_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/text-{uuid.uuid4().hex}"
    edgelist.write_edges(supp_chain_edges(s, d), path)
    return edgelist.read_edges(s, path)


def _csr_vertices(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/csr-{uuid.uuid4().hex}"
    csr.write_csr(cust_part(s, d), path)
    return csr.num_vertices(s, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_edges": _text_roundtrip,
    "sorted_edges": _sorted,
    "make_undirected": lambda s, d: supp_chain(s, d).make_undirected().edges,
    "max_vertex": lambda s, d: cust_part_edges(s, d).agg(F.max(F.greatest("src", "dst")).alias("max_v")),
    "num_vertices": _csr_vertices,
    "out_degree": lambda s, d: cust_part(s, d).out_degrees(),
    "max_out_degree": lambda s, d: cust_part(s, d).max_out_degree(),
    "csr_index": lambda s, d: csr.csr_index(cust_part(s, d)),
    "filter_edges_src": _hub_edges,
    "edge_map_all": lambda s, d: active_edges(cust_part(s, d).with_degree()),
    "edge_map_frontier": lambda s, d: _edge_map(s, d, False),
    "edge_map_range": lambda s, d: _edge_map(s, d, True),
    "vertex_map_all": lambda s, d: _vertex_map(s, d, False),
    "vertex_map_range": lambda s, d: _vertex_map(s, d, True),
    "frontier_members": lambda s, d: frontier.members(busy(cust_part(s, d))),
    "frontier_count": lambda s, d: frontier.count(busy(cust_part(s, d))),
    "frontier_union": _union,
    "frontier_bitmap": _bitmap,
    "frontier_bitmap_roundtrip": _frontier_from_bitmap,
    "bfs_levels": lambda s, d: _bfs(s, d).select("id", "distance"),
    "bfs_parents": lambda s, d: _bfs(s, d).select("id", "parent"),
    "bfs_summary": lambda s, d: alg.bfs_summary(_bfs(s, d)),
    "kcore_members": lambda s, d: alg.kcore_members(_peeled(s, d), CORE),
    "kcore_summary": lambda s, d: alg.kcore_summary(_peeled(s, d), CORE).select(F.lit(CORE).alias("k"), "kth_core_membership"),
    "cc_labels": _labels,
    "cc_sizes": lambda s, d: alg.component_sizes(_labels(s, d)),
    "cc_summary": lambda s, d: alg.components_summary(_labels(s, d)),
    "pagerank_values": lambda s, d: _rounded(_rank(s, d, False)[0]),
    "pagerank_values_chain": lambda s, d: _rounded(_rank(s, d, True)[0]),
    "pagerank_iterations": lambda s, d: _iterations(s, d, False),
    "pagerank_iterations_chain": lambda s, d: _iterations(s, d, True),
    "pagerank_top20": lambda s, d: _rounded(alg.top(_rank(s, d, False)[0])),
    "block_pack": _block_pack,
    "delta_width_hist": _width_hist,
    "codec_stats": _codec_stats,
    "codec_roundtrip": _codec_roundtrip,
    "csr_roundtrip": lambda s, d: _csr(s, d, "raw"),
    "csr_delta_roundtrip": lambda s, d: _csr(s, d, "delta"),
    "dump_edges": lambda s, d: edgelist.edge_lines(supp_chain_edges(s, d)),
    "csr_bfs_levels": lambda s, d: _csr_bfs(s, d, "raw"),
    "csr_delta_bfs_levels": lambda s, d: _csr_bfs(s, d, "delta"),
    "csr_frontier_messages": _csr_frontier,
    "csr_delta_degrees": _csr_degrees,
}

_HUBS = "(SELECT id FROM vd WHERE degree > 30)"
_WIDTH = "CASE WHEN {0} <= 255 THEN 1 WHEN {0} <= 65535 THEN 2 ELSE 4 END"
_DELTAS = "SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS delta, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM e"

#: Blocks of each list one after the other: `pos` values are in blocks, which take `words` words with the list's first.
_STATS = _with(_CUST_PART, "SELECT src, n AS degree, words FROM blocks WHERE pos = n", recursive=f"""widths AS MATERIALIZED (SELECT src, count(*)::BIGINT AS n,
list({_WIDTH.format('coalesce(delta, 0)')} ORDER BY place) AS w FROM ({_DELTAS}) GROUP BY src),
blocks(src, n, pos, words) AS (SELECT src, n, 0::BIGINT, 1::BIGINT FROM widths UNION ALL
SELECT src, n, stop, words + CASE WHEN n - pos = 1 THEN 2 ELSE 2 + ceil(width * (stop - pos - 1) / 4.0) END::BIGINT FROM (
SELECT *, coalesce(list_min([i for i in range(free, most) if w[i + 1] > width]), most)::BIGINT AS stop FROM (
SELECT *, coalesce(list_max(w[pos + 2 : free]), 1) AS width FROM (
SELECT b.*, x.w, least(b.n, pos + 1000) AS most, least(b.n, pos + 10) AS free FROM blocks b JOIN widths x ON b.src = x.src WHERE pos < b.n))))""")

ORACLES: dict[str, str] = {
    "scan_edges": _CHAIN,
    "sorted_edges": f"SELECT row_number() OVER (ORDER BY src, dst) AS rn, src, dst FROM ({_CHAIN})",
    "make_undirected": _with(_CHAIN, "SELECT src, dst FROM e", sym=True),
    "max_vertex": _with(_CUST_PART, "SELECT max(greatest(src, dst)) AS max_v FROM e"),
    "num_vertices": _with(_CUST_PART, "SELECT (max(greatest(src, dst)) + 1)::BIGINT AS num_vertices FROM e"),
    "out_degree": _with(_CUST_PART, "SELECT id, degree FROM vd"),
    "max_out_degree": _with(_CUST_PART, "SELECT max(degree) AS max_out_degree FROM deg"),
    "csr_index": _with(_CUST_PART, "SELECT id, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS begin, (sum(degree) OVER (ORDER BY id))::BIGINT AS end_exclusive FROM vd"),
    "filter_edges_src": _with(_CUST_PART, f"SELECT src, dst FROM e WHERE src IN {_HUBS}"),
    "edge_map_all": _with(_CUST_PART, "SELECT src, dst, degree FROM e JOIN deg ON src = id"),
    "edge_map_frontier": _with(_CUST_PART, f"SELECT dst, count(*)::BIGINT AS messages FROM e WHERE src IN {_HUBS} GROUP BY dst", sym=True),
    "edge_map_range": _with(_CUST_PART, f"SELECT dst, count(*)::BIGINT AS messages FROM e WHERE src IN {_HUBS} AND src < (SELECT count(*) // 2 FROM v) GROUP BY dst", sym=True),
    "vertex_map_all": _with(_CUST_PART, "SELECT id, (degree * 2 + id)::BIGINT AS value FROM vd"),
    "vertex_map_range": _with(_CUST_PART, "SELECT id, CASE WHEN id < (SELECT count(*) // 2 FROM v) THEN degree * 2 + id ELSE 0 END::BIGINT AS value FROM vd"),
    "frontier_members": _with(_CUST_PART, f"SELECT id FROM {_HUBS}"),
    "frontier_count": _with(_CUST_PART, f"SELECT count(*)::BIGINT AS n FROM {_HUBS}"),
    "frontier_union": _with(_CUST_PART, f"SELECT id FROM {_HUBS} UNION SELECT dst FROM e GROUP BY dst HAVING count(*) > 30"),
    "frontier_bitmap": _with(_CUST_PART, f"SELECT id // 32768 AS bucket, count(DISTINCT id)::BIGINT AS set_bits FROM {_HUBS} GROUP BY 1"),
    "frontier_bitmap_roundtrip": _with(_CUST_PART, f"SELECT id FROM {_HUBS}"),
    "bfs_levels": _with(_CHAIN, "SELECT id, distance FROM done", recursive=_BFS),
    "bfs_parents": _with(_CHAIN, "SELECT id, parent FROM done", recursive=_BFS),
    "bfs_summary": _with(_CHAIN, "SELECT max(distance) AS max_distance FROM done", recursive=_BFS),
    "kcore_members": _with(_CUST_PART, f"SELECT id FROM done WHERE degree >= {CORE}", sym=True, recursive=_CORE),
    "kcore_summary": _with(_CUST_PART, f"SELECT {CORE} AS k, count(*)::BIGINT AS kth_core_membership FROM done WHERE degree >= {CORE}", sym=True, recursive=_CORE),
    "cc_labels": _with(_CUST_PART, "SELECT id, label FROM done", sym=True, recursive=_CC),
    "cc_sizes": _with(_CUST_PART, "SELECT label, count(*)::BIGINT AS size FROM done GROUP BY label", sym=True, recursive=_CC),
    "cc_summary": _with(_CUST_PART, "SELECT count(*)::BIGINT AS components, (count(*) FILTER (size > 1))::BIGINT AS non_trivial_components, max(size) AS largest_component_size FROM (SELECT count(*)::BIGINT AS size FROM done GROUP BY label)", sym=True, recursive=_CC),
    "pagerank_values": _with(_CUST_PART, "SELECT id, round(value, 6) AS value FROM done", sym=True, recursive=_RANK),
    "pagerank_values_chain": _with(_CHAIN, "SELECT id, round(value, 6) AS value FROM done", recursive=_RANK),
    "pagerank_iterations": _with(_CUST_PART, "SELECT max(it)::BIGINT AS iterations FROM done", sym=True, recursive=_RANK),
    "pagerank_iterations_chain": _with(_CHAIN, "SELECT max(it)::BIGINT AS iterations FROM done", recursive=_RANK),
    "pagerank_top20": _with(_CUST_PART, "SELECT id, round(value, 6) AS value FROM (SELECT id, value FROM done ORDER BY value DESC, id DESC LIMIT 20)", sym=True, recursive=_RANK),
    "block_pack": _with(_CUST_PART, f"""SELECT DISTINCT n AS num_vals, w AS delta_size, (w << 24) + n AS packed, n AS unpacked_num_vals, w AS unpacked_delta_size FROM
(SELECT src, count(*)::BIGINT AS n, {_WIDTH.format('coalesce(max(delta), 0)')}::INTEGER AS w FROM ({_DELTAS}) GROUP BY src)"""),
    "delta_width_hist": _with(_CUST_PART, f"SELECT {_WIDTH.format('delta')} AS delta_width, count(*)::BIGINT AS n FROM ({_DELTAS}) WHERE delta IS NOT NULL GROUP BY 1"),
    "codec_stats": _STATS,
    "codec_roundtrip": _CUST_PART,
    "csr_roundtrip": _CHAIN,
    "csr_delta_roundtrip": _CUST_PART,
    "dump_edges": f"SELECT src || ' ' || dst AS line FROM ({_CHAIN})",
}
ORACLES |= dict.fromkeys(("csr_bfs_levels", "csr_delta_bfs_levels"), ORACLES["bfs_levels"])
ORACLES["csr_frontier_messages"] = _with(_CUST_PART, "SELECT dst, count(*)::BIGINT AS messages FROM e WHERE src % 64 = 0 GROUP BY dst")
ORACLES["csr_delta_degrees"] = ORACLES["out_degree"]
