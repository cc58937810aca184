"""Pattern packing by non-negative least squares: documents of tokens into as few full sequences as possible.

Documents longer than a sequence are cut into sequence-long pieces (the last may be shorter). What is to be packed is
then a histogram: how many pieces have each length, at most `room` numbers however many documents there are. Patterns of
few long pieces that fill a sequence are enumerated over length classes, repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and the residual (with the many short pieces) is packed best-fit, longest
first, into the gaps and into new sequences. All of it works on counts; the layout it returns has a row for each run of
sequences filled alike.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import bounded, cut, give_back, narrow, trimmed
from vertexloom.llm.tokens import crc_of, word_encoder
from vertexloom.llm.tokenfile import _runs

#: Rows of one length are ranked in chunks of about so many.
CHUNK = 4096


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method, with columns entering one by one."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * len(b)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= scale or used.sum() >= len(b):
            break
        used[k] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            x[at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]] = 0
            used[at] = x[at] > 0
            if not used.any():
                break
    return x


def patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to `most` classes (descending, each at least classes // (2 * most)) that sum up to `classes`."""
    least = max(1, classes // (2 * most))
    out = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0 and len(head) > 1:
            out.append(head)
        if len(head) < most:
            for c in range(min(left, head[-1] if head else classes), least - 1, -1):
                grow((*head, c), left - c)

    grow((), classes)
    return out


@dataclass
class _Bins:
    """Sequences filled alike: `count` of them, `left` tokens free, holding runs (length, how many)."""

    count: int
    left: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def pack(histogram: dict[int, int], room: int = 4096, classes: tuple[int, ...] = (64, 128, 256), few: tuple[int, ...] = (4, 3, 3)) -> list[tuple[int, list[tuple[int, int]]]]:
    """The layout: (number of sequences, [(length, pieces of it in each sequence), ...]); every piece has its place.

    classes: lengths are rounded up to room / classes for the patterns; few: the most pieces in a pattern. Each pair of
    them is a fit of its own, and so are its counts halved, which leaves more to the residual; the layout of the fewest
    sequences is kept. The fit of no pattern is among them, so none is worse than best fit alone.
    """
    tried = [_pack(histogram, room, c, f, share) for c, f in zip(classes, few) for share in (1.0, 0.5)] + [_pack(histogram, room, 1, 1, 0.0)]
    return min(tried, key=lambda packed: sum(count for count, _ in packed))


def _pack(histogram: dict[int, int], room: int, classes: int, few: int, share: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns of a share of their fitted counts, and best fit for what is left."""
    left = {n: c for n, c in histogram.items() if 0 < n <= room and c}
    step = room / classes
    of = lambda n: min(classes, int(np.ceil(n / step)))
    bins: list[_Bins] = []
    found = patterns(classes, few)
    b = np.zeros(classes + 1)
    for n, c in left.items():
        b[of(n)] += c
    long = min((p[-1] for p in found), default=classes)
    if found and b[long:classes].any():
        a = np.zeros((classes + 1, len(found)))
        for k, p in enumerate(found):
            for c in p:
                a[c, k] += 1
        weight = np.where(np.arange(classes + 1) >= long, 1.0, 0.0) / np.sqrt(np.maximum(b, 1.0))
        x = np.floor(share * nnls(a * weight[:, None], b * weight) + 1e-6).astype(int)
        by_class = {c: sorted((n for n in left if of(n) == c), reverse=True) for c in range(1, classes + 1)}
        lengths = sorted(left)
        for k in np.argsort([-p[0] for p in found], kind="stable"):
            todo = int(x[k])
            while todo > 0:  # the longest pieces of each class, as many sequences alike as there are
                taken: dict[int, int] = {}
                for c in found[k][:-1]:
                    n = next((n for n in by_class[c] if left[n] > taken.get(n, 0)), None)
                    if n is None:
                        break
                    taken[n] = taken.get(n, 0) + 1
                else:  # rounding up has left room: the last piece is the longest that fits, be it of a class above
                    free = room - sum(n * m for n, m in taken.items())
                    at = bisect.bisect_right(lengths, free) - 1
                    while at >= 0 and left[lengths[at]] <= taken.get(lengths[at], 0):
                        at -= 1
                    if at < 0 or of(lengths[at]) < found[k][-1]:
                        break
                    taken[lengths[at]] = taken.get(lengths[at], 0) + 1
                    count = min(todo, *(left[n] // m for n, m in taken.items()))
                    bins.append(_Bins(count, room - sum(n * m for n, m in taken.items()), sorted(taken.items(), reverse=True)))
                    for n, m in taken.items():
                        left[n] -= count * m
                    todo -= count
                    continue
                break
    # best fit, longest first: bins of the least sufficient gap take as many as fit
    gaps: dict[int, list[_Bins]] = {}
    keys: list[int] = []

    def put(x: _Bins) -> None:
        if x.left not in gaps:
            gaps[x.left] = []
            bisect.insort(keys, x.left)
        gaps[x.left].append(x)

    for x in bins:
        put(x)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            k = bisect.bisect_left(keys, n)
            if k == len(keys):
                each = room // n
                x = _Bins(max(1, c // each), room)
            else:
                x = gaps[keys[k]].pop()
                if not gaps[keys[k]]:
                    del gaps[keys.pop(k)]
            each = min(x.left // n, c)
            count = min(x.count, c // each)
            if count < x.count:
                put(_Bins(x.count - count, x.left, x.runs))
            put(_Bins(count, x.left - each * n, [*x.runs, (n, each)]))
            c -= count * each
    return [(x.count, x.runs) for xs in gaps.values() for x in xs if x.runs]


class Layout:
    """Where the r-th piece of a length goes: its sequence and its place there."""

    def __init__(self, packed: list[tuple[int, list[tuple[int, int]]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for count, runs in packed:
            at = 0
            for n, each in runs:
                rows.setdefault(n, []).append((taken.get(n, 0), sequence, each, at))
                taken[n] = taken.get(n, 0) + count * each
                at += n * each
            sequence += count
        self.sequences = sequence
        self.rows = {n: np.array(v, np.int64).T for n, v in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            first, base, each, at = self.rows[int(n)]
            k = np.searchsorted(first, rank[own], side="right") - 1
            past = rank[own] - first[k]
            sequence[own] = base[k] + past // each[k]
            offset[own] = at[k] + past % each[k] * n
        return sequence, offset


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every whole text (null: empty) with end_id appended, cut
    into pieces of room tokens. Extra columns of docs are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for lo, hi in _runs(batch.column("text")):
                out: list[list] = [[] for _ in range(5)]
                ids = []
                for i, t in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), encoder.encode_all(batch.column("text").slice(lo, hi - lo))):
                    t = np.append(t, np.uint32(end_id))
                    for p, s in enumerate(range(0, len(t), room)):
                        part = t[s : s + room]
                        for col, v in zip(out, (i, p, s, len(part), crc_of(part))):
                            col.append(v)
                        if keep_ids:
                            ids.append(part.astype(np.int32))
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
                give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def pack_pieces(pieces: DataFrame, room: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence, none above room tokens.

    Only the histogram (at most room rows) reaches the driver, and only the layout of it goes out. A piece's rank among
    those of its length comes from a window in a chunk of about CHUNK rows and prefix sums over the chunks, so that one
    length may hold most rows. Rows that repeat an id are told apart by their checksum; equal ones are interchangeable.
    """
    sums = pieces.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    histogram = dict(zip(sums.column("length").to_pylist(), sums.column("n").to_pylist()))
    layout = Layout(pack(histogram, room))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    most = F.broadcast(pieces.sparkSession.createDataFrame(sums))  # at most room rows, not counted again
    d = pieces.join(most, "length").withColumn("chunk", F.pmod(spread, F.ceil(F.col("n") / CHUNK).cast("long")))
    key = ["length", "chunk"]
    counts = d.groupBy(*key).agg(F.count("*").alias("in_chunk"))
    first = counts.select(*key, (F.sum("in_chunk").over(Window.partitionBy("length").orderBy("chunk")) - F.col("in_chunk")).alias("first"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")) - 1).join(first, key)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = layout.place(batch.column("length").to_numpy(zero_copy_only=False), rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return d.select(*names, (F.col("first") + F.col("rank")).alias("rank")).mapInArrow(trimmed(run), schema)


def pack_query(docs: DataFrame, tokenizer: str, room: int = 4096) -> DataFrame:
    with narrow(docs.sparkSession):  # cut() reads the texts, nothing after it does
        pieces = cut(encode_pieces(docs, tokenizer, room=room), "pieces")
    return pack_pieces(pieces, room)
