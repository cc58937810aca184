"""A binary token-id container with a minimal perfect hash index.

The container is a Parquet folder in a store that Spark reaches; one row is one block of documents that follow each
other in ascending id order:

    part, block     place of the block: ascending (part, block) is ascending id
    first, last     smallest and largest id in the block (null: no id but null)
    start           ids in the blocks of this part before this one
    n_docs          documents in the block
    payload         their ids, raw little-endian unsigned 32-bit integers, one document after the other
    keys            n_docs rows of (id, repetition, null flag) as int64, in payload order
    seeds           the displacement of each hash bucket, int32; below zero a slot itself, -1 - slot
    prints          for each slot the 32-bit fingerprint of its key
    slots           for each slot the first id's place in the payload and the number of ids, int64 pairs

A key's bucket gives the seed, key and seed give the slot, the fingerprint tells strangers apart (one in 2^32 passes),
and the slot gives the slice: constant time, without comparing keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import bounded, cut, give_back, mix, trimmed
from vertexloom.llm.tokens import crc_of, word_encoder

BLOCK_IDS = 1 << 18
BLOCK_DOCS = 4096
SCHEMA = "part int, block int, first long, last long, start long, n_docs int, payload binary, keys binary, seeds binary, prints binary, slots binary"
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def key_hash(ids: np.ndarray, repetition: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys: an id, how often it came before, and whether it is null."""
    return mix(mix(ids.astype(np.uint64) * _A) + repetition.astype(np.uint64) * _B + missing.astype(np.uint64))


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (seed.astype(np.uint64) * _B)) % np.uint64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """A minimal perfect hash over n distinct 64-bit hashes: buckets of about four keys, displaced largest first."""

    seeds: np.ndarray
    n: int

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        n_buckets = max(1, n // 4)
        bucket = (hashes >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
        seeds, free = np.zeros(n_buckets, np.int32), np.ones(n, bool)
        sizes = np.diff(cuts)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = hashes[order[cuts[b] : cuts[b + 1]]]
            base = 0
            while True:  # a run of seeds at once
                tried = np.arange(base, base + 64)
                at = _slot(own[None, :], tried[:, None], n)
                s = np.sort(at, axis=1)
                fits = free[at].all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    seeds[b], free[at[k]] = base + k, False
                    break
                base += 64
                if base >= 2**31 - 64:
                    raise ValueError("two keys have the same hash")
        alone = np.flatnonzero(sizes == 1)
        seeds[alone] = -1 - np.flatnonzero(free)
        return cls(seeds, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        seed = self.seeds[((hashes >> np.uint64(32)) % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.int64)
        return np.where(seed < 0, -1 - seed, _slot(hashes, np.maximum(seed, 0), self.n))


class Block:
    """A block's index over its payload."""

    def __init__(self, row: dict):
        self.start, self.n = row["start"], row["n_docs"]
        self.payload = np.frombuffer(row["payload"], "<u4")
        self.keys = np.frombuffer(row["keys"], "<i8").reshape(-1, 3)
        self.hash = PerfectHash(np.frombuffer(row["seeds"], "<i4"), self.n)
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.at = np.frombuffer(row["slots"], "<i8").reshape(-1, 2)

    @staticmethod
    def write(ids: list[int | None], repetition: list[int], tokens: list[np.ndarray]) -> dict:
        missing = np.array([i is None for i in ids])
        keys = np.stack([np.array([i or 0 for i in ids], np.int64), np.array(repetition, np.int64), missing.astype(np.int64)], axis=1)
        h = key_hash(keys[:, 0], keys[:, 1], keys[:, 2])
        index = PerfectHash.build(h)
        slot = index.slots(h)
        n = np.array([len(t) for t in tokens], np.int64)
        prints, at = np.zeros(len(ids), "<u4"), np.zeros((len(ids), 2), "<i8")
        prints[slot] = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        at[slot, 0], at[slot, 1] = np.cumsum(n) - n, n
        known = [i for i in ids if i is not None]
        return {"first": min(known, default=None), "last": max(known, default=None), "n_docs": len(ids), "payload": np.concatenate(tokens).astype("<u4").tobytes(),
                "keys": keys.astype("<i8").tobytes(), "seeds": index.seeds.astype("<i4").tobytes(), "prints": prints.tobytes(), "slots": at.tobytes()}

    def find(self, ids: np.ndarray, repetition: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in the payload, number of ids) of each key; -1 and 0 for a key whose fingerprint isn't there."""
        h = key_hash(ids, repetition, missing)
        slot = self.hash.slots(h)
        ok = self.prints[slot] == (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(ok, self.at[slot, 0], -1), np.where(ok, self.at[slot, 1], 0)


def write_container(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes every whole text of docs (null: empty), appends end_id, and writes the container to the shared folder.

    Rows with equal ids keep their own entries (repetition 0, 1, ... by the text's hash), null ids come last. A table without
    rows gives a container without rows. The texts are shuffled once, by ranges of id, hash and row, so that an id that
    many rows have goes to several parts, in each of which repetitions count from 0. They are encoded after that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        ids, reps, tokens, size, block, start = [], [], [], 0, 0, 0
        last, rep = (), 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "block": block, "start": start} | Block.write(ids, reps, tokens)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for lo, hi in _runs(batch.column("text")):
                for i, t in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), encoder.encode_all(batch.column("text").slice(lo, hi - lo))):
                    rep = rep + 1 if (i,) == last else 0
                    last = (i,)
                    ids.append(i)
                    reps.append(rep)
                    tokens.append(np.append(t, np.uint32(end_id)))
                    size += len(tokens[-1])
                    if size >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                        yield flush()
                        start, block = start + size, block + 1
                        ids, reps, tokens, size = [], [], [], 0
                give_back()
        if ids:
            yield flush()

    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("n_docs", pa.int32()),
                       *((c, pa.binary()) for c in ("payload", "keys", "seeds", "prints", "slots"))])
    d = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), "hash", "row"]
    ordered = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(ordered.mapInArrow(trimmed(run), SCHEMA), "tokens")


def _runs(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes of text."""

    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def read_container(container: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document, each found through the index of its block.

    start: ids of all documents before it. Only the totals of the parts (one number for each partition written) reach
    the driver.
    """
    totals = container.groupBy("part").agg(F.sum(F.octet_length("payload") / 4).cast("long").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                place, n = b.find(b.keys[:, 0], b.keys[:, 1], b.keys[:, 2])
                if (place < 0).any():
                    raise ValueError(f"part {row['part']}, block {row['block']}: the index doesn't know a key of its own")
                crc = [crc_of(b.payload[p : p + k]) for p, k in zip(place.tolist(), n.tolist())]
                ids = pa.array(b.keys[:, 0], mask=b.keys[:, 2].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place + b.start + base[row["part"]]), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    cols = [c for c in container.columns if c not in ("first", "last")]
    return container.select(cols).mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(container: DataFrame, doc_ids: list[int], repetition: int = 0) -> DataFrame:
    """Rows (doc_id, ids) for those of the given ids that the container holds; blocks that can't hold one aren't read. Of an
    id that lies in several parts, the entry of that repetition in each."""
    hit = F.lit(False)
    for i in doc_ids:
        hit = hit | ((F.col("first") <= i) & (F.col("last") >= i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                own = np.array([i for i in doc_ids if row["first"] <= i <= row["last"]], np.int64)
                place, n = b.find(own, np.full(len(own), repetition), np.zeros(len(own), np.int64))
                keep = place >= 0
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array([b.payload[p : p + k].astype(np.int64) for p, k in zip(place[keep], n[keep])], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return container.where(hit).mapInArrow(trimmed(run), "doc_id long, ids array<long>")


def token_file_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_container(write_container(docs, tokenizer))
