"""Shared pieces of the training-data operators: shared-folder tables, connected components, text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = (9, 10, 11, 12, 13, 32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster sets it.

    Only where it is unset a folder is chosen: a temporary one with a local master, else one in the warehouse.
    """
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        said = f"file://{tempfile.mkdtemp(prefix='vertexloom-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 1 << 22


def bounded(docs: DataFrame) -> DataFrame:
    """docs, in a session whose batches for Python workers have at most about BATCH_BYTES: by rows alone, 10,000 long texts
    would be gigabytes. A smaller bound that the session has stays. The bound changes no result, and is left set."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    said = re.fullmatch(r"(\d+)b?", conf.get(name) or "")
    if not said or int(said[1]) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


#: Rows of a batch that Parquet's reader makes where texts are read.
BATCH_ROWS = 64


@contextlib.contextmanager
def narrow(spark: SparkSession):
    """What runs within it reads Parquet in batches of at most BATCH_ROWS rows. The reader holds the texts of a batch in one
    array, which grows by doubling: by the usual 4096 rows, long texts would be half a gigabyte and more in each task. A
    smaller bound that the session has stays; its own bound comes back afterwards. The bound changes no result."""
    conf, name = spark.conf, "spark.sql.parquet.columnarReaderBatchSize"
    said = conf.get(name)
    conf.set(name, str(min(int(said), BATCH_ROWS)))
    try:
        yield
    finally:
        conf.set(name, said)


def narrowed(docs: DataFrame) -> DataFrame:
    """docs, in a session that reads Parquet as within narrow(), which is left set: for frames that run later on."""
    conf, name = docs.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    conf.set(name, str(min(int(conf.get(name)), BATCH_ROWS)))
    return docs


def sweep(spark: SparkSession) -> None:
    """Lets the JVM of each executor collect its garbage and give back the heap that is free then. By itself it keeps what
    the step before took, and what the next one's Python workers take comes on top of it. Where all executors are idle the
    scheduler deals one of the tasks to each; one that is left out only stays as large as it is. Takes some tenths of a second."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def swept(df: DataFrame) -> DataFrame:
    """df, after sweep(): for steps that large ones come before."""
    sweep(df.sparkSession)
    return df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the table behind a frame that cut() returned."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith("file:/") and not folder.startswith("file://"):
            folder = "file://" + folder[5:]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | object, buckets: int):
    """crc32 of the id written as text, modulo buckets."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def _components_here(edges: pa.Table) -> pa.Table:
    """components() of a few edges, by hooking larger roots to smaller ones."""
    a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        x, y = root[a[open_]], root[b[open_]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(ids[root], pa.int64())})


def components(edges: DataFrame, local: int = 0) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the smallest id reached. Up to
    `local` distinct edges are joined on the driver, which spares the rounds; the result is the same.

    Alternates large-star and small-star steps, each cut to the shared folder, until the edges are stars whose
    centres are the smallest ids. Ids without an edge (or with a self-loop only) get no row.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if local and e.count() <= local:
        found = _components_here(e.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow())
        drop_cut(e)
        return edges.sparkSession.createDataFrame(found)
    before = None
    while True:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u's smaller neighbours and u itself point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small, "edges")
        after = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_cut(e)
        e = new
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def may_hold(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (row, may) for the rows of docs: may is false only where doc_id isn't among ids (doc_id), true for the others
    and a few more. row holds docs' columns whatever their names.

    One bit for each hash value, at least 16 for each id up to 2^27 bits (16 MB) in all: that bounds what is broadcast.
    """
    n = max(1, ids.count())
    bits = 1 << min(27, max(16, (16 * n - 1).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bucket = F.floor(F.col("h") / 32768)
    held = ids.where("doc_id is not null").select(at("doc_id").alias("h")).groupBy(bucket.alias("bucket")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits"))
    d = docs.select(F.struct("*").alias("row"), at("doc_id").alias("h")).withColumn("bucket", bucket).join(F.broadcast(held), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(h % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return d.select("row", F.coalesce(F.getbit(byte, F.expr("cast(h % 8 as int)")) == 1, F.lit(False)).alias("may"))


# -- text kernels ------------------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for k, base in (("up", _STEP), ("down", _BACK)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words (runs of bytes other than SPACES) of one text: starts, ends, and a hash of any byte range."""

    def __init__(self, data: bytes, lower: bool = True):
        b = np.frombuffer(data, np.uint8)
        up, self._down = _powers(len(b) + 1)
        self._sum = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[b] * up[: len(b)], out=self._sum[1:])
        gap = np.ones(len(b) + 2, bool)
        gap[1:-1] = _IS_SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of their heads up to ends."""
        ends = self.ends if ends is None else ends
        return mix((self._sum[ends] - self._sum[self.starts]) * self._down[self.starts] + (ends - self.starts).astype(np.uint64))


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of width lower-cased (A-Z) words; with fewer words the whole sequence is one."""
    w = Words(data).hashes()
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    k = min(width, len(w))
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += w[i : i + n] * _PLACES[i]
    return np.unique(mix(h))


# -- what Python workers keep ------------------------------------------------------------------------------------------

_HELD: dict[object, object] = {}


def held(key: object, make):
    """make(), kept in this Python worker for the tasks that follow and ask for the same key. Only the last one is kept,
    and the memory of what was before is given back, so that workers that serve one operator after another stay small."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives back what held() and the kernels keep, and what allocators hold."""
    _HELD.clear()
    _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    trim()


def trim() -> None:
    """Collects garbage, and gives back what allocators hold in reserve."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives back what allocators hold in reserve; takes about a millisecond."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """run (batches -> batches) for mapInArrow; when a task ends, its worker gives back the memory that it took."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
