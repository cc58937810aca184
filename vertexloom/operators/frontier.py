"""Sets of vertices: members, counts, unions, and a bitmap form for storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in a bitmap bucket.
BUCKET = 32768


def empty(vertices: DataFrame) -> DataFrame:
    return vertices.withColumn("active", F.lit(False))


def everything(vertices: DataFrame) -> DataFrame:
    return vertices.withColumn("active", F.lit(True))


def of(vertices: DataFrame, condition: Column) -> DataFrame:
    """vertices with `active`: whether the condition holds."""
    return vertices.withColumn("active", F.coalesce(condition, F.lit(False)))


def members(frontier: DataFrame) -> DataFrame:
    return frontier.where("active").select("id")


def count(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if("active").alias("n"))


def is_empty(frontier: DataFrame) -> bool:
    return frontier.where("active").isEmpty()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of either set, once each."""
    return members(a).unionByName(members(b)).distinct()


def bitmap(frontier: DataFrame) -> DataFrame:
    """(bucket, bits): id's bit is id % BUCKET of bucket id div BUCKET; buckets without a member are left out."""
    m = members(frontier).select(F.expr(f"id div {BUCKET}").alias("bucket"), (F.col("id") % BUCKET).alias("at"))
    return m.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))


def from_bitmap(bits: DataFrame) -> DataFrame:
    """(id) of the members of a bitmap."""
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    at = bits.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(BUCKET - 1))))
    return at.where(F.getbit(byte, F.expr("cast(at % 8 as int)")) == 1).select((F.col("bucket") * BUCKET + F.col("at")).cast("long").alias("id"))
