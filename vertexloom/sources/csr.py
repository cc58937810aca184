"""Compressed sparse row files: `.idx` (unsigned 64-bit first edge of each vertex) and `.adj` (unsigned 32-bit targets), or
with the delta codec `.idx2` (first word of each vertex's list) and `.adj2` (words). Little-endian, without headers.

A graph is written as a folder: for each part, which holds a range of vertices, one index and one adjacency file whose
offsets count from the part's own start, and a manifest that says where parts begin. single_file() joins them into one
pair of files in the plain format, which can be read too. Files are reached through pyarrow's file systems, so a folder
may be in any store that these know.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vertexloom.functions.codec import CompressionOptions, compress, decompress
from vertexloom.graph import Graph


@dataclass(frozen=True)
class Codec:
    """How a list of ascending ids becomes 32-bit words: compress(ids, options) and decompress(words), both of arrays; None
    where words are the ids. degree_first: a list's first word is its length. suffixes: of the index and adjacency files."""

    suffixes: tuple[str, str]
    compress: Callable[[np.ndarray, CompressionOptions], np.ndarray] | None = None
    decompress: Callable[[np.ndarray], np.ndarray] | None = None
    degree_first: bool = False


CODECS = {"raw": Codec(("idx", "adj")), "delta": Codec(("idx2", "adj2"), compress, decompress, degree_first=True)}
SUFFIX = {name: codec.suffixes for name, codec in CODECS.items()}
#: A read partition holds about so many index entries.
READ_VERTICES = 1 << 20


@dataclass(frozen=True)
class Part:
    name: str
    vertex_start: int
    vertices: int
    edges: int
    words: int


def codec_of(name: str) -> Codec:
    """A codec of this module, or that of "module:name", which executors import too."""
    if name in CODECS:
        return CODECS[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"no codec is called {name}")
    return getattr(import_module(module), attribute)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _read(path: str, start: int, size: int) -> bytes:
    system, where = _open(path)
    with system.open_input_file(where) as f:
        return f.read_at(size, start)


def csr_index(graph: Graph, blocks: int | None = None) -> DataFrame:
    """(id, begin, end_exclusive) of all vertices: the running sum of out-degrees, in blocks of ids and over the blocks,
    so that no window spans all vertices."""
    n = blocks or max(1, graph.num_vertices // 65536)
    size = -(-graph.num_vertices // n)
    d = graph.out_degrees().withColumn("block", F.expr(f"id div {size}"))
    total = d.groupBy("block").agg(F.sum("degree").alias("n"))
    base = total.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))  # a row for each block
    end = F.sum("degree").over(Window.partitionBy("block").orderBy("id"))
    d = d.withColumn("end", end).join(base, "block")
    return d.select("id", (F.col("base") + F.col("end") - F.col("degree")).alias("begin"), (F.col("base") + F.col("end")).alias("end_exclusive"))


def num_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(num_vertices) of a graph folder, from the sizes of its index files alone; fails if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx*").load(path).select("length")
    return files.agg((F.sum("length") / 8).cast("long").alias("num_vertices"))


def write_csr(graph: Graph, path: str, codec: str = "raw", options: CompressionOptions = CompressionOptions(), parts: int | None = None) -> list[Part]:
    """Writes the graph folder and returns its parts. Each part is a range of vertices of about equal size, written by one
    task; the driver gets one row for each part. A task that runs again writes the same files.

    Edges reach a task sorted and are written as they come, whatever a vertex's degree; with a codec that packs whole lists
    one list at a time is in memory. codec: "raw", "delta", or "module:name" of a Codec."""
    n = parts or graph.partitions
    span = -(-graph.num_vertices // n)
    total, chosen = graph.num_vertices, codec_of(codec)
    idx, adj = chosen.suffixes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vertexloom.sources.csr import _PartWriter

        writer = None
        for batch in batches:
            part = batch.column("part").to_numpy()
            for lo, hi in _runs(part):
                at = int(part[lo])
                if writer is None or writer.part != at:
                    if writer:
                        yield writer.close()
                    writer = _PartWriter(path, at, at * span, min(span, total - at * span), codec, options)
                rows = batch.slice(lo, hi - lo)
                rows = rows.filter(rows.column("src").is_valid())
                writer.add(rows.column("src").to_numpy(), rows.column("dst").to_numpy())
        if writer:
            yield writer.close()

    system, where = _open(path)
    system.create_dir(where)
    edges = graph.edges.select(F.expr(f"src div {span}").alias("part"), "src", "dst")
    marks = graph.spark.range(-(-total // span)).select(F.col("id").alias("part"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))  # parts without edges are written too
    ordered = edges.unionByName(marks).repartition(n, "part").sortWithinPartitions("part", "src", "dst")
    found = ordered.mapInArrow(write, "name string, vertex_start long, vertices long, edges long, words long").collect()
    out = [Part(**r.asDict()) for r in sorted(found, key=lambda r: r.vertex_start)]
    with system.open_output_stream(posixpath.join(where, "manifest.json")) as f:
        f.write(json.dumps({"codec": codec, "index": idx, "adjacency": adj, "parts": [asdict(p) for p in out]}).encode())
    return out


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of equal keys."""
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(lo, hi) for lo, hi in zip(edge, edge[1:]) if lo < hi]


class _PartWriter:
    """Streams one part's adjacency; its index, a number for each vertex, is written at the end."""

    def __init__(self, path: str, part: int, start: int, vertices: int, codec: str, options: CompressionOptions):
        system, where = _open(path)
        self.part, self.name, self.start, self.codec, self.options = part, f"part-{part:06d}", start, codec_of(codec), options
        idx, adj = self.codec.suffixes
        self.idx = system.open_output_stream(posixpath.join(where, f"{self.name}.{idx}"))
        self.adj = system.open_output_stream(posixpath.join(where, f"{self.name}.{adj}"))
        self.words, self.edges = np.zeros(vertices, np.int64), 0
        self.source, self.pending = -1, []

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        """Edges by source, then target; a list may go on with the next call."""
        self.edges += len(src)
        if self.codec.compress is None:
            self.words += np.bincount(src - self.start, minlength=len(self.words))
            self.adj.write(dst.astype("<u4").tobytes())
            return
        for lo, hi in _runs(src):
            if src[lo] != self.source:
                self._flush()
                self.source = int(src[lo])
            self.pending.append(dst[lo:hi])

    def _flush(self) -> None:
        if self.pending:
            words = self.codec.compress(np.concatenate(self.pending), self.options)
            self.adj.write(words.astype("<u4").tobytes())
            self.words[self.source - self.start] = len(words)
            self.pending = []

    def close(self) -> pa.RecordBatch:
        self._flush()
        ends = np.cumsum(self.words)
        self.idx.write((ends - self.words).astype("<u8").tobytes())
        self.idx.close()
        self.adj.close()
        return pa.RecordBatch.from_pylist([{"name": self.name, "vertex_start": self.start, "vertices": len(self.words), "edges": self.edges, "words": int(self.words.sum())}])


def single_file(path: str, target: str, piece: int = 1 << 24) -> None:
    """Joins a graph folder into target.idx and target.adj (or .idx2 and .adj2), piece by piece."""
    m = manifest(path)
    system, where = _open(path)
    out_system, out = _open(target)
    with out_system.open_output_stream(f"{out}.{m['index']}") as idx, out_system.open_output_stream(f"{out}.{m['adjacency']}") as adj:
        base = 0
        for p in m["parts"]:
            for suffix, stream, shift in ((m["index"], idx, True), (m["adjacency"], adj, False)):
                with system.open_input_stream(posixpath.join(where, f"{p['name']}.{suffix}")) as f:
                    while data := f.read(piece):
                        stream.write((np.frombuffer(data, "<u8") + np.uint64(base)).tobytes() if shift else data)
            base += p["words"]


def manifest(path: str) -> dict:
    system, where = _open(path)
    with system.open_input_stream(posixpath.join(where, "manifest.json")) as f:
        return json.loads(f.read())


@dataclass
class _Slice(InputPartition):
    """Vertices [lo, hi) of a part, as places in its index file."""

    idx: str
    adj: str
    vertex_start: int
    vertices: int
    words: int
    lo: int
    hi: int
    codec: str

    def __hash__(self):
        return hash((self.idx, self.lo))


class CsrReader(DataSourceReader):
    """Reads edges in order of src, those of src in [srcFrom, srcTo) where these options are given: parts and index ranges
    outside aren't read."""

    def __init__(self, options: dict):
        self.path, self.codec = options.get("path"), options.get("codec")
        self.idx, self.adj, self.step = options.get("idx"), options.get("adj"), int(options.get("verticesPerPartition", READ_VERTICES))
        self.lo, self.hi = int(options.get("srcFrom", 0)), int(options.get("srcTo", 2**32))
        self.only = {int(x) for x in options["blocks"].split(",") if x} if "blocks" in options else None
        self.degrees = options.get("degrees") == "true"

    def partitions(self) -> list[_Slice]:
        if self.path:
            m = manifest(self.path)
            if m["codec"] not in CODECS and m["codec"] != self.codec:  # a file doesn't decide which module is imported
                raise ValueError(f"the folder needs the codec {m['codec']}: name it as an option")
            self.codec = m["codec"]
            files = [(f"{self.path}/{p['name']}.{m['index']}", f"{self.path}/{p['name']}.{m['adjacency']}", p["vertex_start"], p["vertices"], p["words"]) for p in m["parts"]]
        else:
            size = lambda p: _open(p)[0].get_file_info(_open(p)[1]).size
            if size(self.idx) is None:
                raise FileNotFoundError(self.idx)
            if size(self.idx) < 8:
                raise ValueError("a graph without vertices")
            self.codec = self.codec or ("delta" if self.idx.endswith("2") else "raw")
            files = [(self.idx, self.adj, 0, size(self.idx) // 8, size(self.adj) // 4)]
        out = []
        for idx, adj, start, n, words in files:
            lo, hi = max(0, self.lo - start), min(n, self.hi - start)
            if self.only is None:
                out += [_Slice(idx, adj, start, n, words, k, min(hi, k + self.step), self.codec) for k in range(lo, hi, self.step)]
                continue
            runs: list[list[int]] = []  # blocks that follow each other are read as one
            for b in sorted(b for b in self.only if lo < (b + 1) * self.step - start and b * self.step - start < hi):
                at, end = max(lo, b * self.step - start), min(hi, (b + 1) * self.step - start)
                if runs and runs[-1][1] == at and end - runs[-1][0] <= READ_VERTICES:
                    runs[-1][1] = end
                else:
                    runs.append([at, end])
            out += [_Slice(idx, adj, start, n, words, at, end, self.codec) for at, end in runs]
        return out

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        codec = codec_of(part.codec)
        more = part.hi < part.vertices  # the place after the last list is in the index, or is the end of the file
        at = np.frombuffer(_read(part.idx, part.lo * 8, (part.hi - part.lo + more) * 8), "<u8").astype(np.int64)
        ends = at if more else np.append(at, part.words)
        if self.degrees:
            yield self._degrees(part, ends, codec)
            return
        group = 1 << 20  # words in memory at once, but for longer lists
        v = 0
        while v < part.hi - part.lo:
            stop = max(v + 1, int(np.searchsorted(ends, ends[v] + group, side="right")) - 1)
            stop = min(stop, part.hi - part.lo)
            words = np.frombuffer(_read(part.adj, int(ends[v]) * 4, int(ends[stop] - ends[v]) * 4), "<u4")
            if codec.decompress:
                lists = [codec.decompress(words[ends[k] - ends[v] : ends[k + 1] - ends[v]]) for k in range(v, stop)]
                size, dst = np.array([len(x) for x in lists]), np.concatenate(lists)
            else:
                size, dst = np.diff(ends[v : stop + 1]), words.astype(np.int64)
            src = np.repeat(np.arange(v, stop) + part.lo + part.vertex_start, size)
            yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64))], ["src", "dst"])
            v = stop


    def _degrees(self, part: _Slice, ends: np.ndarray, codec: Codec) -> pa.RecordBatch:
        """The length of each list: what its first word says with the delta codec, else the distance of offsets, or for
        other codecs what comes out of each list."""
        n = np.diff(ends)
        if codec.decompress and not codec.degree_first:
            words = lambda k: np.frombuffer(_read(part.adj, int(ends[k]) * 4, int(n[k]) * 4), "<u4")
            n = np.array([len(codec.decompress(words(k))) if n[k] else 0 for k in range(len(n))], np.int64)
        elif codec.degree_first and n.any():
            system, where = _open(part.adj)
            full = np.flatnonzero(n)
            with system.open_input_file(where) as f:
                n[full] = [int.from_bytes(f.read_at(4, int(at) * 4), "little") for at in ends[full]]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(part.lo, part.hi) + part.vertex_start), pa.array(n.astype(np.int64))], ["id", "degree"])


class CsrDataSource(DataSource):
    """spark.read.format("csr").load(folder), or with options idx and adj for one pair of files."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "id long, degree long" if self.options.get("degrees") == "true" else "src long, dst long"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str | None = None, idx: str | None = None, adj: str | None = None, src_from: int = 0, src_to: int = 2**32, codec: str | None = None) -> DataFrame:
    """(src, dst) of a graph folder, or of one pair of files; only sources in [src_from, src_to) are read from disk.

    The range is an option, not a pushed filter: Spark keeps one reader for all uses of a frame, and a filter pushed by
    one use would hold for the others. codec: for files that were written with one named "module:name".
    """
    spark.dataSource.register(CsrDataSource)
    r = spark.read.format("csr").option("srcFrom", src_from).option("srcTo", src_to)
    r = r.option("codec", codec) if codec else r
    return r.load(path) if path else r.option("idx", idx).option("adj", adj).load()


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    """(id, degree) of all vertices of a graph folder, without reading lists."""
    spark.dataSource.register(CsrDataSource)
    return spark.read.format("csr").option("degrees", "true").load(path)


def open_graph(spark: SparkSession, path: str | None = None, idx: str | None = None, adj: str | None = None) -> Graph:
    """The graph in a folder, or in one pair of files; its number of vertices is that of the index. Raises ValueError if it
    has none."""
    if path:
        n = sum(p["vertices"] for p in manifest(path)["parts"])
    else:
        system, where = _open(idx)
        n = (system.get_file_info(where).size or 0) // 8
    if not n:
        raise ValueError("a graph without vertices")
    return Graph(read_csr(spark, path, idx, adj), n)


def active_edges(spark: SparkSession, path: str, frontier: DataFrame, block: int = 4096) -> DataFrame:
    """(src, dst) of the sources in frontier(id, ...), with its other columns. Only blocks of `block` vertices that hold one
    are read; those that follow each other are read as one. The blocks' numbers reach the driver: V / block at most."""
    blocks = frontier.select(F.expr(f"id div {block}").alias("b")).distinct().collect()
    spark.dataSource.register(CsrDataSource)
    r = spark.read.format("csr").option("verticesPerPartition", block).option("blocks", ",".join(str(x.b) for x in blocks))
    return r.load(path).join(frontier.withColumnRenamed("id", "src"), "src")
