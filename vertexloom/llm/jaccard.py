"""N-gram Jaccard join: the size-aware, heavy-light set similarity join over word shingles.

Sets of at most `x` shingles are light, the others heavy. Light sets find each other by enumerated subsets of fixed size
K: if two sets overlap in o >= K shingles, the K first of these in one global order lie in both sets' first
n - o + K shingles, so both enumerate that subset. Heavy sets find all others by scanning inverted lists: the list of a
shingle holds the sets that have it among their first n - o + 1. Here o is the least overlap that a partner may have,
ceil(least * n). The boundary x is where the cost of enumerating, summed over the sets up to x, plus that of scanning,
summed over the sets beyond it, is least.

The global order is by frequency class, then hash. Classes come from counters of hashed shingles over all documents (a
table of fixed size); any order is right, and one that puts frequent shingles last keeps the lists short.

Before texts are compared, a bound by bitmaps decides most candidates exactly: each set has the parity of its shingles
in as many bits as it has shingles, or more, and two sets differ in no fewer shingles than their bitmaps in bits.

A list is worked off by pivots: its first K_r sets, in one order for all lists, are paired with all that follow them, and
leave it; in the next round the rest goes on, with more pivots, unless all its sets are known to be in one component by
then. So a list whose sets are alike costs a star, not all pairs, and no pair of sets of different components is missed.

Lists of frequent shingles are dealt to several tasks: the counters say about how long a list is, each task gets a share of
its sets, and all of them get its pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import bounded, components, cut, drop_cut, held, may_hold, mix, shingle_set, swept, trimmed

#: Size of the subsets that light sets enumerate.
K = 2
#: A share of a list is so many times its pivots or more, since each share gets them all.
SHARE_PIVOTS = 16
#: So many links are joined to components on the driver (16 bytes each); more of them in rounds of small jobs.
LOCAL_LINKS = 1 << 18
#: Candidates for the boundary between light and heavy sets.
BOUNDARIES = tuple(range(0, 41))


@dataclass(frozen=True)
class Params:
    """Links need num / den of the union in common. counters: how many hashed counters order the shingles (4 bytes each,
    sent to every executor). pivots: of a list, in the first round; each later round takes `more` times as many. share:
    about how many sets of a list one task gets, at least SHARE_PIVOTS times the pivots."""

    num: int = 75
    den: int = 100
    width: int = 5
    counters: int = 1 << 20
    pivots: int = 4
    more: int = 16
    share: int = 1024

    def overlap(self, n):
        """The least overlap of a set of n with a partner: ceil(num / den * n)."""
        return -(-(self.num * n) // self.den)

    def differ(self, both):
        """In how many shingles at most two linked sets of `both` shingles in sum differ."""
        return (self.den - self.num) * both // (self.den + self.num)

    def indexed(self, n):
        """How many first shingles the smaller set of a pair must be found by: n - ceil(2 num n / (num + den)) + 1."""
        return n + (-2 * self.num * n) // (self.num + self.den) + 1


def _sum_counters(rows: DataFrame, size: int) -> np.ndarray:
    """Adds up partial counters (chunk, salt, part): first by chunk and salt, then by chunk, each row by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for c, s, x in zip(*(batch.column(k).to_pylist() for k in ("chunk", "salt", "part"))):
                v = np.frombuffer(x, "<i8")
                total[c, s] = total[c, s] + v if (c, s) in total else v
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["chunk", "salt", "part"])

    schema = "chunk int, salt int, part binary"
    once = rows.repartition("chunk", "salt").mapInArrow(trimmed(add), schema).withColumn("salt", F.lit(0))
    out = np.zeros(size, np.int64)
    for r in once.repartition("chunk").mapInArrow(trimmed(add), schema).collect():  # counters of fixed size
        v = np.frombuffer(r.part, "<i8")
        out[r.chunk * len(v) : (r.chunk + 1) * len(v)] += v
    return out


def describe(docs: DataFrame, p: Params) -> DataFrame:
    """One pass over the texts: rows (doc_id, n, d1, d2) with the size and a 128-bit digest of each set, and rows (chunk,
    salt, part) with the counters of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", lambda: None)
        counters = np.zeros(p.counters, np.int64)
        for batch in batches:
            n, d1, d2 = [], [], []
            hashes = []
            for x in batch.column("text"):
                s = shingle_set((x.as_py() or "").encode("utf-8"), p.width)
                n.append(len(s))
                a, b = digest(s)
                d1.append(a)
                d2.append(b)
                hashes.append(s & np.uint64(p.counters - 1))
            if hashes:
                counters += np.bincount(np.concatenate(hashes).astype(np.int64), minlength=p.counters)
            m = len(n)
            none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *none], names)
        size = max(1, p.counters // 64)
        task = TaskContext.get().partitionId()
        parts = [(c, counters[c * size : (c + 1) * size]) for c in range(-(-p.counters // size))]
        parts = [(c, v.astype("<i8").tobytes()) for c, v in parts if v.any()]
        none = [pa.nulls(len(parts), pa.int64()) for _ in range(4)]
        yield pa.RecordBatch.from_arrays([*none, pa.array([c for c, _ in parts], pa.int32()), pa.array([task % 16] * len(parts), pa.int32()), pa.array([v for _, v in parts], pa.binary())], names)

    names = ["doc_id", "n", "d1", "d2", "chunk", "salt", "part"]
    return docs.mapInArrow(trimmed(run), "doc_id long, n long, d1 long, d2 long, chunk int, salt int, part binary")


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes; equal sets have equal digests."""
    both = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), (mix(s + np.uint64(0x14057B7EF767814F)) * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)], np.uint64)
    return tuple(int(v) for v in both.view(np.int64))


def frequency_class(counters: np.ndarray) -> np.ndarray:
    """For each counter how far it stands out: 0 unless beyond the mean by what chance explains, then by doublings."""
    mean = counters.mean() if len(counters) else 0.0
    over = np.maximum(0.0, counters - mean - 5 * np.sqrt(mean)) / 8
    return np.ceil(np.log2(1 + over)).astype(np.uint8)


def sizes(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """About how many sets have each shingle: 0 unless its counter stands out."""
    c = classes[(s & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.int64)
    return np.where(c > 0, 8 << c, 0)


def in_order(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order; s is sorted by hash."""
    return s[np.argsort(classes[(s & np.uint64(len(classes) - 1)).astype(np.int64)], kind="stable")]


def bitmap(s: np.ndarray) -> bytes:
    """The parity of a set's hashes in 2^k words of 64 bits, 2^k * 64 >= 2 n, up to 256 words."""
    words = 1 << min(8, max(2, (2 * len(s) - 1).bit_length() - 6))
    odd = np.bincount((s & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of many sets, and how many bits pairs of them differ in: the longer one is folded upon itself."""

    def __init__(self, data: list[bytes]):
        size = np.array([len(x) // 8 for x in data], np.int64)
        self.size, self.at, self.levels = size, np.zeros(len(data), np.int64), {}
        for w in np.unique(size).tolist():
            own = np.flatnonzero(size == w)
            self.at[own] = np.arange(len(own))
            m = np.frombuffer(b"".join(data[i] for i in own), "<u8").reshape(-1, w)
            self.levels[w, w] = m
            while w > 4:
                m = m[:, : w // 2] ^ m[:, w // 2 :]
                w //= 2
                self.levels[len(data[own[0]]) // 8, w] = m

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        kinds = self.size[a] * 1024 + self.size[b]
        for kind in np.unique(kinds).tolist():
            k = np.flatnonzero(kinds == kind)
            wa, wb = divmod(kind, 1024)
            w = min(wa, wb)
            x = self.levels[wa, w][self.at[a[k]]] ^ self.levels[wb, w][self.at[b[k]]]
            out[k] = np.bitwise_count(x).sum(axis=1)
        return out


def heads(docs: DataFrame, sent: Broadcast, p: Params) -> DataFrame:
    """A second pass: rows (doc_id, n, d1, d2, least, head, bits, cost): the n - o + K first shingles as bytes, the few
    least hashes, the bitmap, and what scanning the lists costs. Empty sets and null ids give none."""
    weight = np.concatenate([[1.0], 8.0 * np.exp2(np.arange(64))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                s = shingle_set((x.as_py() or "").encode("utf-8"), p.width)
                if not len(s) or i is None:
                    continue
                n = len(s)
                first = in_order(s, known)[: n - p.overlap(n) + K]
                cost = float(weight[known[(first & np.uint64(len(known) - 1)).astype(np.int64)]].sum())
                for col, v in zip(out, (i, n, *digest(s), s[:4].tobytes(), first.tobytes(), bitmap(s), cost)):
                    col.append(v)
            types = [pa.int64()] * 4 + [pa.binary()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names = ["doc_id", "n", "d1", "d2", "least", "head", "bits", "cost"]
    return docs.mapInArrow(trimmed(run), "doc_id long, n long, d1 long, d2 long, least binary, head binary, bits binary, cost double")


def boundary(sets: DataFrame, p: Params) -> int:
    """The size up to which sets are light: where enumerating costs less in total."""
    top = max(BOUNDARIES)
    rows = sets.groupBy(F.least("n", F.lit(top + 1)).alias("n")).agg(F.sum("cost").alias("scan"), F.count("*").alias("sets")).collect()
    scan, light = np.zeros(top + 2), np.zeros(top + 2)
    for r in rows:
        scan[r.n] = r.scan
        light[r.n] = r.sets * comb(min(r.n, r.n - p.overlap(r.n) + K), K) if r.n <= top else np.inf
    costs = [light[1 : x + 1].sum() + scan[x + 1 :].sum() for x in BOUNDARIES]
    return BOUNDARIES[int(np.argmin(costs))]


def subsets(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all subsets of size min(K, n) of the first shingles, and the subsets as places; sets below K are their own
    subset."""
    k = min(K, n)
    at = np.array(list(combinations(range(len(first)), k)), np.int64)
    h = np.full(len(at), 0x51, np.uint64)
    for c in range(k):
        h = mix(h + first[at[:, c]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
    return h, at


ENTRY = "sig long, doc long, n long, first boolean, scan boolean, size long, comp long, bits binary"


def entries(sets: DataFrame, x: int | None, p: Params, sent: Broadcast, above: int = -1) -> DataFrame:
    """Entries of the lists: (sig, doc, n, first, scan, size, comp), those of size > above. size: about how long the list is,
    0 if not known to be long. first: the set may be the smaller one of a pair found
    here; scan: an inverted list, for pairs with a heavy set. With x None one entry for each of the few least hashes, with
    the set's bitmap."""
    arrow = pa.schema([("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("scan", pa.bool_()), ("size", pa.int64()), ("comp", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            sig, first, scan, size, count = [], [], [], [], []
            for n, data in zip(batch.column("n").to_pylist(), batch.column("head").to_pylist()):
                s = np.frombuffer(data, np.uint64)
                long = sizes(s, known)
                if x is None:
                    parts = [(s, np.ones(len(s), bool), long, False)]
                else:
                    parts = []
                    if n <= x:
                        h, at = subsets(s, n)
                        parts.append((h, np.ones(len(h), bool), long[at].min(axis=1), False))
                    if p.den * n > p.num * x:  # heavy, or near enough to have a heavy partner
                        h = s[: n - p.overlap(n) + 1]
                        parts.append((h, np.arange(len(h)) < p.indexed(n), long[: len(h)], True))
                count.append(0)
                for h, f, lg, sc in parts:
                    if above >= 0:
                        keep = lg > above
                        h, f, lg = h[keep], f[keep], lg[keep]
                    count[-1] += len(h)
                    sig.append(h)
                    first.append(f)
                    size.append(lg)
                    scan.append(np.full(len(h), sc))
            if not sum(count):
                continue
            rep = np.repeat(np.arange(batch.num_rows), count)
            kinds = np.concatenate(scan)
            h = np.concatenate(sig) ^ np.where(kinds, np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5))
            cols = [pa.array(h.view(np.int64)), *(batch.column(c).take(pa.array(rep)) for c in ("doc_id", "n")), pa.array(np.concatenate(first)), pa.array(kinds), pa.array(np.concatenate(size)), batch.column("comp").take(pa.array(rep)), batch.column("bits").take(pa.array(rep))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    head, bits = ("least", F.col("bits")) if x is None else ("head", F.lit(None).cast("binary"))
    return sets.select("doc_id", "n", F.col(head).alias("head"), "comp", bits.alias("bits")).mapInArrow(trimmed(run), ENTRY)


def order() -> tuple:
    """The order of a list: which sets are its pivots doesn't depend on how it is dealt out."""
    return F.xxhash64("doc"), F.col("doc"), F.col("first").desc(), F.col("scan")


def dealt(listed: DataFrame, hot: DataFrame | None, pivots: int, p: Params) -> DataFrame:
    """listed with salt, the share of its list that an entry belongs to, and copy: true for the entries of a list's pivots in
    the other shares. hot: the entries of size > share, or None if there is none; their lists are counted, since copies of
    a text count in a size but are one set."""
    if hot is None:
        return listed.withColumns({"salt": F.lit(0), "copy": F.lit(False)})
    share = max(p.share, SHARE_PIVOTS * pivots)
    counted = hot.groupBy("sig").agg(F.count("*").alias("sets")).where(F.col("sets") > share)
    shares = F.coalesce(F.ceil(F.col("sets") / share).cast("int"), F.lit(1))
    rows = hot.join(counted, "sig", "left").withColumn("shares", shares).withColumn("salt", F.pmod(F.hash("doc"), "shares")).drop("sets")
    top = rows.where("shares > 1")
    for keys in (("sig", "salt"), ("sig",)):
        top = top.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order()))).where(F.col("place") <= pivots).drop("place")
    others = F.array_except(F.sequence(F.lit(0), F.col("shares") - 1), F.array("salt"))
    copies = top.withColumn("salt", F.explode(others)).withColumn("copy", F.lit(True))
    cold = listed.where(F.col("size") <= p.share).withColumns({"salt": F.lit(0), "copy": F.lit(False)})
    return cold.unionByName(rows.withColumn("copy", F.lit(False)).drop("shares")).unionByName(copies.drop("shares"))


def stars(listed: DataFrame, hot: DataFrame | None, x: int, pivots: int, p: Params) -> DataFrame:
    """Works off `pivots` sets of each list: rows (a, b) of candidate pairs, and rows (sig, doc, ...) of what stays in
    lists. Reads the lists, or shares of long ones, as a stream; of each only the pivots are held. Where entries have bitmaps, pairs that these
    rule out aren't given."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("scan", pa.bool_()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # the pivots of the list that the last batch ended in
        seen = 0  # its length so far
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = carry.num_rows if carry is not None else 0
            rows = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            sig, salt, copy = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "salt", "copy"))
            edge = np.concatenate([[0], np.flatnonzero((sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])) + 1])
            group = np.cumsum(np.isin(np.arange(len(sig)), edge, assume_unique=True)) - 1
            start = edge[group]
            place = np.arange(len(sig)) - start
            if lead:
                own = group == 0
                place[own] = np.where(np.arange(own.sum()) < lead, place[own], place[own] - lead + seen)
            doc, n, comp = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "n", "comp"))
            first, scan = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("first", "scan"))
            new = np.arange(len(sig)) >= lead
            found = []
            bits = Bitmaps(rows.column("bits").to_pylist()) if rows.column("bits").null_count == 0 else None
            for k in range(min(pivots, int(place.max()) + 1)):
                b = np.flatnonzero(new & ~copy & (place > k))
                if not len(b):
                    break
                a = start[b] + k
                small = np.where(n[a] < n[b], True, np.where(n[a] > n[b], False, doc[a] < doc[b]))
                lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                ok = (comp[a] != comp[b]) & (p.den * lo >= p.num * hi)
                ok &= np.where(lo == hi, first[a] | first[b], np.where(small, first[a], first[b]))
                ok &= ~scan[a] | (hi > x)
                a, b = a[ok], b[ok]
                if bits is not None and len(a):
                    ok = bits.differ(a, b) <= p.differ(n[a] + n[b])
                    a, b = a[ok], b[ok]
                found.append(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], schema=arrow)
            stays = np.flatnonzero(new & (place >= pivots))
            if len(stays):
                kept = rows.take(pa.array(stays))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(stays), pa.int64())] * 2 + [kept.column(c) for c in ("sig", "doc", "n", "first", "scan", "size")], schema=arrow)
            last = np.flatnonzero(group == group[-1])
            carry = rows.take(pa.array(last[:pivots]))
            seen = int(place[-1]) + 1

    ordered = dealt(listed, hot, pivots, p).repartition("sig", "salt").sortWithinPartitions("sig", "salt", *order())
    return ordered.mapInArrow(trimmed(run), "a long, b long, sig long, doc long, n long, first boolean, scan boolean, size long")


def possible(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that the sizes and bitmaps of their sets don't rule out."""
    own = sets.select("doc_id", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            bits = Bitmaps(batch.column("x").to_pylist() + batch.column("y").to_pylist())
            both = batch.column("n").to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(bits.differ(np.arange(m), np.arange(m, 2 * m)) <= p.differ(both))
            yield batch.select(["a", "b"]).take(pa.array(ok))

    left = own.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x"))
    right = own.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y"))
    d = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("n"))
    return d.mapInArrow(trimmed(run), "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (doc_id, distinct)."""
    return may_hold(docs, ids).where("may").select("row.*").join(ids, "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose texts link. Texts of the documents that occur in pairs are shuffled to the pairs' smaller
    document, and meet the other's there; sets are compared whole, as 64-bit hashes."""
    if pairs.isEmpty():
        return pairs
    occur = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "occur")
    texts = texts_of(docs, occur)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                data = s.as_py()
                if data != last:
                    last, left = data, shingle_set((data or "").encode("utf-8"), p.width)
                right = shingle_set((t.as_py() or "").encode("utf-8"), p.width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both and p.den * both >= p.num * (len(left) + len(right) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), "a long, b long")


def jaccard_components(docs: DataFrame, params: Params = Params(), links: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every row of docs (doc_id, text), and n_links where links are asked for.

    A document's set: the distinct shingles of its whole text; two documents link when den * |A and B| >= num * |A or B|.
    component_id is the smallest doc_id reachable by links. Null and empty texts, and texts without words, have no
    shingle and link with nothing; so do rows without an id (component_id null). Rows with equal sets are one class,
    joined to its smallest id without being compared. Rows that repeat an id with other texts count as one document where
    both represent their class. Extra columns are ignored, an empty table gives no rows.

    n_links: how many other rows a row links with. For it no candidate pair of classes is left out because its sets are in
    one component already, so lists are worked off whole: a group of near copies costs all its pairs. Copies are counted.
    """
    p, counted = params, links
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = swept(cut(describe(docs, p), "described"))
    light = seen.where("n is not null").select("doc_id", "n", "d1", "d2")
    classes = frequency_class(_sum_counters(seen.where("chunk is not null").select("chunk", "salt", "part"), p.counters))
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    longest = int(8 << int(classes.max(initial=0)))  # of all lists
    made = heads(docs, sent, p).groupBy("d1", "d2")
    sets = swept(cut(made.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cost").alias("cost"), F.first("least").alias("least"), F.first("head").alias("head"), F.first("bits").alias("bits"), *([F.count("*").alias("copies")] if counted else [])), "sets"))
    x = boundary(sets, p)
    # round 0: the few least hashes join most of what is nearly equal
    own = sets.withColumn("comp", F.col("doc_id"))
    hot = cut(entries(own, None, p, sent, p.share), "hot") if longest > p.share else None
    star = cut(stars(entries(own, None, p, sent), hot, 0, 1, p), "stars")
    links = swept(cut(verify(cut(star.where("a is not null").select("a", "b").distinct(), "pairs"), docs, p), "links"))
    drop_cut(star)
    comp = cut(components(links, LOCAL_LINKS), "components")
    known = comp.where("false") if counted else comp  # components that lists may be left for
    own = _labelled(sets, "doc_id", known)
    listed = entries(own, x, p, sent)
    hot = cut(entries(own, x, p, sent, p.share), "hot") if longest > p.share else None
    pivots, rest, texts = p.pivots, None, docs
    while True:
        star = cut(stars(listed, hot, x, pivots, p), "stars")
        pairs = star.where("a is not null").select("a", "b").distinct()
        new = cut(verify(cut(possible(pairs, sets, p) if rest is None else pairs, "pairs"), texts, p), "links")
        links = links.unionByName(new)
        if not new.isEmpty():
            # what was joined before is a star already, so few steps are needed
            comp = cut(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new), LOCAL_LINKS), "components")
            known = known if counted else comp
        left = _labelled(star.where("sig is not null").select("sig", "doc", "n", "first", "scan", "size"), "doc", known)
        open_ = left.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
        left = left.join(open_, "sig", "left_semi").join(sets.select(F.col("doc_id").alias("doc"), "bits"), "doc")
        left = swept(cut(left.select("sig", "doc", "n", "first", "scan", "size", "comp", "bits"), "rest"))
        drop_cut(star)
        if rest is not None:
            drop_cut(rest)
        if left.isEmpty():
            break
        if texts is docs:  # later rounds read the texts of what is left, not all documents again and again
            occur = cut(left.select(F.col("doc").alias("doc_id")).distinct(), "occur")
            texts = cut(may_hold(docs, occur).where("may").select("row.*"), "texts")  # a few more, but without a shuffle
        listed, rest, pivots = left, left, pivots * p.more
        hot = left.where(F.col("size") > p.share) if longest > p.share else None
    if texts is not docs:
        drop_cut(texts)
    # every row to its class, and the class to its component
    joined = sets.select("d1", "d2", F.col("doc_id").alias("rep")).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    extra = []
    if counted:
        joined = joined.join(_linked(sets, links), "rep", "left")
        extra = [F.col("n_links")]
    joined = joined.select("d1", "d2", F.coalesce("component", "rep").alias("component"), *extra)
    out = light.join(joined, ["d1", "d2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    extra = [F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if counted else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *extra)


def _linked(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (rep, n_links): with how many other rows each row of a class links, those of its own class among them."""
    copies = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("copies").alias("copies"))
    once = links.distinct()
    ends = once.select(F.col("a").alias("id"), F.col("b").alias("rep")).unionByName(once.select(F.col("b").alias("id"), F.col("a").alias("rep")))
    others = ends.join(copies, "rep").groupBy(F.col("id").alias("rep")).agg(F.sum("copies").alias("others"))
    return copies.join(others, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def _labelled(rows: DataFrame, doc: str, comp: DataFrame) -> DataFrame:
    """rows with comp: the component of their document, itself where it has no link."""
    rows = rows.drop("comp")
    return rows.join(comp.select(F.col("id").alias(doc), "component"), doc, "left").withColumn("comp", F.coalesce("component", doc)).drop("component")


def jaccard_query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
