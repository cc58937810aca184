"""Bottom-k fingerprints of word shingles (DataFrame operations only).

A fingerprint is the k smallest distinct 48-bit hashes of a text's five-word shingles (words: runs of bytes other than
space and U+0009 to U+000D, A-Z lower-cased; with fewer words the whole sequence is one shingle; without words none),
ascending, as an array<bigint>. Fingerprints of parts merge into that of the whole, and estimate resemblance,
containment and the number of distinct shingles. Equal texts, and texts that differ in white space or in the case of
A-Z only, have equal fingerprints. A null text is an empty text.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WIDTH = 5
BITS = 48


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bottom_k(text: Column, k: int = K) -> Column:
    """The fingerprint of a text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")

    def sketch(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0)))
        # get() is null beyond the end, and xxhash64 skips nulls: a short sequence is hashed as one shingle
        shingles = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(WIDTH)]), 64 - BITS))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_distinct(F.sort_array(shingles)), 1, k))

    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), sketch)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together (shingles across their seam belong to neither)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(rows: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(keys, fingerprint) of each group's parts together; null keys are a group, groups of empty parts have an empty one.

    Hashes are made distinct and ranked as rows, partly before their shuffles: no task holds a group.
    """
    one = rows.select(*keys, F.explode_outer(fingerprint).alias("_hash")).groupBy(*keys, "_hash").count()
    low = Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last())
    least = one.withColumn("_rank", F.row_number().over(low)).where(F.col("_rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias("fingerprint"))  # collect_list skips null


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity; 1 for two empty fingerprints, 0 if just one is empty."""

    def of(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u).cast("double"))

    return _let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the largest kept hash's share."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has: resemblance times the union's size over a's size."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The hashes as hexadecimal digits, 12 for each."""
    return F.concat_ws("", F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))))


def _upto(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are at most value, by a coarse list of them and then one stretch of the fine list."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    coarse = F.size(F.filter(listed(cuts[::step]), lambda c: c <= value))
    fine = F.slice(listed(cuts), F.greatest((coarse - 1) * step + 1, F.lit(1)), F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda c: c <= value)))


def blocks(docs: DataFrame, per_block: int = 512, most: int = 10_000) -> Column:
    """A column that cuts docs (doc_id) into blocks of about per_block rows, at most about `most`, that follow each other as
    ids do. Cuts are quantiles of the ids, so it doesn't matter how ids lie. An id that fills several blocks, or a null,
    is dealt to them by chance; null ids come first of all, below 0."""
    s = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("n")).first()
    m = max(1, min(most, s.n // per_block))
    cuts = []
    if m > 1:
        quantiles = docs.agg(F.percentile_approx("doc_id", [k / m for k in range(1, m)], 10 * m).alias("cuts"))
        cuts = sorted(quantiles.first().cuts)
    chance = F.xxhash64(F.monotonically_increasing_id())
    block = _upto(cuts, F.col("doc_id"))
    hot = {v: c for v, c in Counter(cuts).items() if c > 1}
    if hot:  # fewer than there are cuts
        span = F.from_json(F.lit(json.dumps({str(v): c for v, c in hot.items()})), "map<string,int>")
        block = block - F.coalesce(F.pmod(chance, F.element_at(span, F.col("doc_id").cast("string")).cast("long")), F.lit(0)).cast("int")
    nulls = max(1, min(most, (s.rows - s.n) // per_block))
    return F.coalesce(block.cast("long"), -1 - F.pmod(chance, F.lit(nulls))).cast("long")


def with_next(docs: DataFrame, per_block: int = 512) -> DataFrame:
    """Rows (doc_id, text, fingerprint, next_text, next_fingerprint): next is the document that follows in descending doc_id,
    after the last the first. Null ids come last. Rows that repeat an id follow each other in some order. One row alone
    follows itself. No rows give no rows; extra columns are ignored.

    Each block of ids is a window group, and the head of the block that follows is joined to a block's last row. No window
    spans the documents; the one over block numbers has a narrow row for each block. Texts are shuffled once (the heads
    are read from the same shuffle); fingerprints are made after that and not moved.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = d.withColumn("block", blocks(d, per_block))
    d = placed.repartition("block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    ranked = d.withColumn("rank", F.row_number().over(order)).withColumn("lead_text", F.lead("text").over(order))
    heads = ranked.where("rank = 1").select("block", F.col("text").alias("head_text"))
    all_blocks = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc())
    whole = all_blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = placed.groupBy("block").count().select(F.col("block").alias("of"), F.coalesce(F.lead("block").over(all_blocks), F.first("block").over(whole)).alias("block"))
    follows = heads.join(F.broadcast(numbers), "block").select(F.col("of").alias("block"), "head_text").withColumn("head_fp", bottom_k(F.col("head_text")))
    run = ranked.withColumn("fingerprint", bottom_k(F.col("text")))
    run = run.withColumn("lead_fp", F.lead("fingerprint").over(order)).join(follows, "block", "left")
    last = F.col("lead_text").isNull()
    return run.select("doc_id", "text", "fingerprint", F.when(last, F.col("head_text")).otherwise(F.col("lead_text")).alias("next_text"), F.when(last, F.col("head_fp")).otherwise(F.col("lead_fp")).alias("next_fingerprint"))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and that of the next document."""
    d = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    d = d.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), F.col("fingerprint").alias("own"), F.col("next_fingerprint").alias("after"), bottom_k(F.col("edited")).alias("changed"))
    own, after, changed = F.col("own"), F.col("after"), F.col("changed")
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"), resemblance(own, changed).alias("near_edited"), resemblance(own, after).alias("near_next"),
                    distinct_shingles(own).alias("n_shingles_est"), containment(changed, own).alias("edited_contained"))
