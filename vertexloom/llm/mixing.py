"""Mixing sources to target weights by systematic sampling (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.common import cut

#: A chunk (rows of one source, size class and hash) has about so many rows.
CHUNK = 4096


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 1): eight hexadecimal digits of md5(seed and source)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("+"), source), F.lit("-"))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): one row for each source.

    Sources by code point, null last, weigh weights[0], weights[1], ... and again. share times the sum of all sizes is
    dealt by weight; a target stops at most times its source's size and the excess is dealt again by weight until none
    is above. In the order of most * size / weight the sources that stop come first, so prefix sums give the level.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    d = sizes.withColumn("weight", w).withColumn("top", F.col("source_size") * F.lit(float(most)))
    rising = one.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    d = d.withColumn("total", total).withColumn("stopped", F.coalesce(F.sum("top").over(upto), F.lit(0.0)))
    d = d.withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the level if this source and all after it stay open; the first source below whose own top it lies fixes it
    d = d.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("level"))
    d = d.withColumn("fixed", F.first(fits, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("top"), F.col("fixed") * F.col("weight")), F.col("top"))
    return d.select("source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", size: Column | None = None, few: int = 100_000) -> DataFrame:
    """Rows (row, mix) for the rows of docs, mix = struct(size, source_size, target, copies): how often the mix takes each.

    size: a column of docs' sizes; the number of words of `text` where it isn't given. row holds docs' columns whatever
    their names. A document's expected copies are its source's target over its source's size, at most `most`. Within a
    source the documents are lined up by size class, hash and size; the prefix sums of their expected copies, plus the
    source's one random offset, are cut at the integers, and a document is taken once for each integer it crosses. So no
    document is taken more often than expected, rounded up, and the words taken differ from the target by about one
    long document. Reruns agree: offset and order follow from seed, source, id and size. Rows equal in id and size are
    interchangeable. Null texts and texts without words have size 0, are lined up as all others, and add no words; in a
    source without words nothing is taken. Null is a source of its own, in the last place. No rows give no rows.

    A source may hold most rows: no window spans it. Rows are lined up in chunks of about CHUNK rows; prefix sums over
    the chunks' counts give each chunk's first place. The sources' targets are broadcast if they are at most `few` rows,
    else joined.
    """
    source = F.col("source").cast("string")
    d = docs.select(F.struct("*").alias("row"), source.alias("source"), F.coalesce(F.concat(F.lit("+"), source), F.lit("-")).alias("key"), F.col("doc_id").alias("doc_id"), (n_words(F.col("text")) if size is None else size.cast("long")).alias("size"))
    goal = cut(targets(d.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, most), "goal")
    known = goal.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("key"), "n", "source_size", "target")
    d = d.join(F.broadcast(known) if goal.count() <= few else known, "key")
    # eight classes for each doubling of the size, the largest first
    d = d.withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int"))
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    d = d.withColumn("chunk", F.pmod(digits, F.ceil(F.col("n") / F.lit(CHUNK)).cast("long")))
    place = ["key", "class", "chunk"]
    counts = d.groupBy(*place).agg(F.count("*").alias("in_chunk"))
    in_order = Window.partitionBy("key").orderBy(F.col("class").desc(), "chunk")
    first = counts.select(*place, (F.sum("in_chunk").over(in_order) - F.col("in_chunk")).alias("first"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(F.col("size").desc(), "doc_id")) - 1).join(first, place)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("first") + F.col("rank")
    u = offset(F.col("source"), seed)
    copies = F.floor(rate * (at + 1) + u) - F.floor(rate * at + u)
    return d.select("row", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def mix_query(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; words are counted once, into a narrow table."""
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    d = mix(sizes, size=F.col("size"))
    return d.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
