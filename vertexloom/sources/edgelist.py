"""Text edge lists: `src dst` on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, comment: str | None = None, mode: str = "failfast") -> DataFrame:
    """(src, dst) of lines (value). Blank lines, and with `comment` lines that begin with it, are left out. Other lines
    that don't hold two whole numbers raise an error when read (failfast), or are left out (drop)."""
    d = lines.select(F.trim(F.regexp_replace("value", r"[\t\r]", " ")).alias("value")).where("value <> ''")
    if comment:
        d = d.where(~F.col("value").startswith(comment))
    parts = F.split("value", " +")
    ok = F.col("value").rlike(r"^\d+ +\d+$")
    if mode == "drop":
        d = d.where(ok)
    elif mode != "failfast":
        raise ValueError(f"no mode {mode}")
    check = F.when(ok, parts[0]).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), "value")).cast("string"))
    return d.select(check.cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def read_edges(spark: SparkSession, path: str, comment: str | None = None, mode: str = "failfast") -> DataFrame:
    return parse(spark.read.text(path), comment, mode)


def edge_lines(edges: DataFrame) -> DataFrame:
    """(line) `src dst` of each edge."""
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))


def write_edges(edges: DataFrame, path: str) -> None:
    edge_lines(edges).select(F.col("line").alias("value")).write.text(path)
