"""Whole conversions: text edge list to CSR folder, plain to delta-compressed folder, folder to text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vertexloom.functions.codec import CompressionOptions
from vertexloom.graph import Graph
from vertexloom.sources import csr, edgelist


def edgelist_to_csr(spark: SparkSession, infile: str, outdir: str, make_undirected: bool = False, comment: str | None = None) -> Graph:
    """Neighbours come out ascending whatever the order of lines."""
    g = Graph.from_edges(edgelist.read_edges(spark, infile, comment))
    g = g.make_undirected() if make_undirected else g
    csr.write_csr(g, outdir)
    return g


def compress_csr(spark: SparkSession, path: str, outdir: str, options: CompressionOptions = CompressionOptions(), adj: str | None = None) -> None:
    """A plain CSR folder, or the pair of files path and adj, rewritten as a folder with the delta codec. Vertices at the end
    without edges keep their place."""
    csr.write_csr(csr.open_graph(spark, idx=path, adj=adj) if adj else csr.open_graph(spark, path), outdir, "delta", options)


def csr_to_text(spark: SparkSession, path: str, outdir: str, adj: str | None = None) -> None:
    """`src dst` lines of either kind of folder, or of the pair of files path and adj."""
    edgelist.write_edges(csr.read_csr(spark, idx=path, adj=adj) if adj else csr.read_csr(spark, path), outdir)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=["edgelist2csr", "compress", "print"])
    p.add_argument("--infile", "--idx", "-i", required=True, help="text, a graph folder, or with --adj an index file")
    p.add_argument("--adj", "-a", help="the adjacency file that belongs to the index file")
    p.add_argument("--outdir", "-o", required=True)
    p.add_argument("--pair", help="join the folder that is written into one index and one adjacency file of this name")
    p.add_argument("--make-undirected", action="store_true")
    p.add_argument("--sorted", "-s", action="store_true", help="lines are sorted; the result is the same, as each part is sorted after its shuffle anyway")
    a = p.parse_args(args)
    if a.adj and a.step == "edgelist2csr" or a.pair and a.step == "print":
        p.error("--adj is for graphs, --pair for steps that write one")
    spark = SparkSession.builder.getOrCreate()
    if a.step == "edgelist2csr":
        edgelist_to_csr(spark, a.infile, a.outdir, a.make_undirected)
    elif a.step == "compress":
        compress_csr(spark, a.infile, a.outdir, adj=a.adj)
    else:
        csr_to_text(spark, a.infile, a.outdir, a.adj)
    if a.pair:
        csr.single_file(a.outdir, a.pair)


if __name__ == "__main__":
    main()
