"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vertexloom.llm.common import components, cut, trimmed


@dataclass(frozen=True)
class Params:
    """tables of codes of `width` cross-polytope hashes each; each vector also probes its `probes` next likely buckets. Width
    0: by the number of vectors, so that strangers seldom meet (`sparse` buckets for each vector). Tables 0: as many, ten
    at least, as bring together the share `recall` of pairs at cosine `least`, by trial on made-up pairs, at any width.
    Buckets of more than `block` entries are compared in blocks of about so many."""

    least: float = 0.95
    tables: int = 0
    width: int = 0
    probes: int = 2
    sparse: float = 4.0
    recall: float = 0.995
    block: int = 1024
    seed: int = 11

    def sized(self, n: int, dim: int) -> Params:
        d = 1 << max(0, dim - 1).bit_length()
        wide = math.ceil(math.log(max(2.0, n * self.sparse)) / math.log(2.0 * d))
        width = self.width or max(1, min(6, wide, 56 // (d.bit_length())))  # a bucket's number has 57 bits
        p = replace(self, width=width, tables=self.tables or 10)
        if not self.tables and dim > 1:
            met = p.meeting(dim)
            while (1 - met) ** p.tables > 1 - self.recall and p.tables < 64:
                p = replace(p, tables=p.tables + 1)
        return p

    def meeting(self, dim: int, pairs: int = 500, tables: int = 4) -> float:
        """The share of pairs at cosine `least` that meet in a table."""
        rng = np.random.Generator(np.random.PCG64(self.seed + 1))
        x, y = rng.normal(size=(2, pairs, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = self.least * x + math.sqrt(1 - self.least**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        (hx, px), (hy, py) = codes(x, replace(self, tables=tables)), codes(y, replace(self, tables=tables))
        return float(((hx == hy) | (px == hy[:, :, None]).any(axis=2) | (py == hx[:, :, None]).any(axis=2)).mean())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, orthonormal; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(home, probes) of unit rows: bucket numbers [n, tables] and [n, tables, probes] (-1: no such bucket).

    Each hash rotates by three rounds of random signs and a Hadamard transform, and takes the nearest signed axis. A
    probe replaces one hash of the code by its second-nearest axis; those that give up least come first.
    """
    n, dim = x.shape
    d = 1 << max(0, dim - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.Generator(np.random.PCG64(p.seed))
    home = np.zeros((n, p.tables), np.int64)
    probes = np.full((n, p.tables, p.probes), -1, np.int64)
    for t in range(p.tables):
        best, second, loss = [], [], []
        for _ in range(p.width):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            a = np.abs(y)
            i = a.argmax(axis=1)
            r = np.arange(n)
            top = a[r, i].copy()
            a[r, i] = -1.0
            j = a.argmax(axis=1)
            best.append(i * 2 + (y[r, i] < 0))
            second.append(j * 2 + (y[r, j] < 0))
            loss.append(top - a[r, j])
        base = [(2 * d) ** k for k in range(p.width)]
        home[:, t] = sum(b * s for b, s in zip(best, base))
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
        for k in range(min(p.probes, p.width)):
            which = order[:, k]
            delta = np.stack([(s2 - b) * s for b, s2, s in zip(best, second, base)], axis=1)[np.arange(n), which]
            probes[:, t, k] = home[:, t] + delta
    return home, probes


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Float64 rows of a list column whose lists all have dim items."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow and underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _met(rows: dict, i: np.ndarray, j: np.ndarray, p: Params) -> np.ndarray:
    """Those of the linked pairs (i, j) of rows that are to be counted where they are now: indices of shape [2, m].

    A pair that meets in several buckets is counted in the first table where it meets, there in the bucket both are at
    home in, or else in the lower of the two.
    """
    keep = (rows["home"][i] | rows["home"][j]) & (rows["vec_id"][i] != rows["vec_id"][j])
    i, j = i[keep], j[keep]
    found = [np.zeros((2, 0), np.int64)]
    big = np.iinfo(np.int64).max
    for lo in range(0, len(i), 65536):
        i_, j_ = i[lo : lo + 65536], j[lo : lo + 65536]
        own = np.unique(np.concatenate([i_, j_]))
        home, probes = codes(rows["x"][own], p)
        a, b, t, m = np.searchsorted(own, i_), np.searchsorted(own, j_), rows["t"][i_], np.arange(len(i_))
        same = home[a] == home[b]
        into_b = (probes[a] == home[b][:, :, None]).any(axis=2)
        into_a = (probes[b] == home[a][:, :, None]).any(axis=2)
        first = (same | into_a | into_b).argmax(axis=1) == t
        ha, hb = home[a, t], home[b, t]
        place = np.where(same[m, t], ha, np.minimum(np.where(into_a[m, t], ha, big), np.where(into_b[m, t], hb, big)))
        ok = first & (place == rows["number"][i_])
        found.append(np.stack([i_[ok], j_[ok]]))
    return np.concatenate(found, axis=1)


def _in_block(rows: dict, lo: int, hi: int, p: Params) -> np.ndarray:
    """Links between part lo and part hi of a bucket."""
    left = np.flatnonzero(rows["part"] == lo)
    right = left if lo == hi else np.flatnonzero(rows["part"] == hi)
    i, j = np.nonzero(rows["x"][left] @ rows["x"][right].T >= p.least)
    i, j = left[i], right[j]
    keep = (i < j) if lo == hi else np.ones(len(i), bool)
    return _met(rows, i[keep], j[keep], p)


def _in_groups(rows: dict, group: np.ndarray, p: Params) -> np.ndarray:
    """Links within many small groups at once; group ascends. Rows are compared with those 1, 2, ... places on."""
    found, n, d = [], len(group), 1
    while d < n:
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            break
        i = i[np.einsum("ij,ij->i", rows["x"][i], rows["x"][i + d]) >= p.least]
        found.append(np.stack([i, i + d]))
        d += 1
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return _met(rows, i, j, p)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 is joined to by pairs [2, m]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        new = root.copy()
        np.minimum.at(new, pairs[0], low)
        np.minimum.at(new, pairs[1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Two vectors link when hashing brings them together and their cosine in double precision is at least params.least;
    vectors of different lengths never do. Components of type float stay so until they are compared, all others are
    doubles. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Equal
    vectors (by 128 bits of hash) are one class with a count: they link with each other without being compared, and only
    one of them is hashed. A null vec_id links with nothing either (component_id null, kept false). Rows that repeat a
    vec_id are one vector to the components. An empty table gives no rows; extra columns are ignored.

    Entries (a vector in its own bucket, and in those it probes) are narrow rows, written once. Only those of buckets in
    which vectors meet are joined with their vectors and shuffled by bucket; a bucket of many entries is split into
    parts, and each pair of parts is a block of its own, so that no task holds more than two parts. A block gives for
    each vector the number of its links and one edge to its root, never the pairs themselves.
    """
    kind = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    fine = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)
    fine &= F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("e", lambda v: v != 0)
    valid = rows.where(F.coalesce(fine, F.lit(False))).withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(7), "e")})
    classes = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    classes = cut(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    dims = [(r.dim, r.n) for r in classes.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).collect()]
    sized = {d: params.sized(n, d) for d, n in dims}

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
            size = pc.list_value_length(batch.column("e")).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                p = sized[int(dim)]
                home, probes = codes(_unit(matrix(part.column("e"), int(dim))), p)
                number = np.concatenate([home[:, :, None], probes], axis=2)
                at = np.where(number >= 0, number * 64 + np.arange(p.tables)[None, :, None], -1).reshape(-1)
                uid = part.column("uid").to_numpy()[:, None, None] * 2 + (np.arange(1 + p.probes) == 0)  # odd: at home
                uid = np.broadcast_to(uid, number.shape).reshape(-1)
                ok = at >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), dim, np.int32)), pa.array(at[ok]), pa.array(uid[ok])], ["dim", "at", "member"])

    entries = cut(classes.select("uid", "e").mapInArrow(trimmed(enter), "dim int, at long, member long"), "entries")
    bucket = ["dim", "at"]
    some = entries.groupBy(*bucket).agg(F.count("*").alias("n"), F.max(F.col("member") % 2).alias("home")).where("n > 1 and home = 1")
    live = entries.join(some.select(*bucket, F.ceil(F.col("n") / params.block).cast("int").alias("parts")), bucket)
    live = live.select(*bucket, "parts", F.expr("member div 2").alias("uid"), (F.col("member") % 2 == 1).alias("home"))
    live = live.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts").cast("long")).cast("int"))
    blocks = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("dim", (F.col("at") % 64).cast("int").alias("t"), F.expr("at div 64").alias("number"), "uid", "home", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    blocks = blocks.join(classes.select("uid", F.col("rep").alias("vec_id"), "copies", "e"), "uid").drop("uid")
    key = ["dim", "t", "number", "lo", "hi"]

    def columns(block: pa.RecordBatch, dim: int) -> dict:
        out = {c: block.column(c).to_numpy(zero_copy_only=False) for c in ("t", "number", "home", "part", "vec_id", "copies")}
        return out | {"x": _unit(matrix(block.column("e"), dim))}

    def told(r: dict, pairs: np.ndarray) -> pa.RecordBatch:
        """For each row its links and an edge to the smallest row it is joined to; rows without links are left out."""
        size = len(r["vec_id"])
        n = np.bincount(pairs[0], weights=r["copies"][pairs[1]], minlength=size) + np.bincount(pairs[1], weights=r["copies"][pairs[0]], minlength=size)
        hit, root = np.flatnonzero(n), _roots(size, pairs)
        return pa.RecordBatch.from_arrays([pa.array(r["vec_id"][hit]), pa.array(r["vec_id"][root[hit]]), pa.array(n[hit].astype(np.int64))], ["a", "b", "n"])

    def together(blocks_: list[pa.RecordBatch], dim: int) -> pa.RecordBatch:
        r = columns(pa.Table.from_batches(blocks_).combine_chunks().to_batches()[0], dim)
        group = np.repeat(np.arange(len(blocks_)), [b.num_rows for b in blocks_])
        return told(r, _in_groups(r, group, sized[dim]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, size, of = [], 0, 0  # small groups wait until there are enough to be compared at once
        for (dim, _, _, lo, hi), block in grouped(batches, key):
            if few and (of != dim or size > 4096):
                yield together(few, of)
                few, size = [], 0
            if 1 < block.num_rows <= 64 and lo == hi:
                few.append(block)
                size += block.num_rows
                of = dim
            elif block.num_rows > 1:
                r = columns(block, dim)
                yield told(r, _in_block(r, lo, hi, sized[dim]))
        if few:
            yield together(few, of)

    links = cut(blocks.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(compare), "a long, b long, n long"), "links")
    joined = components(links)
    count = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    member = valid.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).select("vec_id", "rep", "copies")
    member = member.join(count, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = member.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of equal keys in sorted batches; a group is held whole."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *edge], [*edge, batch.num_rows]):
            k = tuple(int(c[lo]) for c in cols)
            if k != last and held:
                yield last, whole()
                held = []
            last = k
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, whole()


def near_duplicate_query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
