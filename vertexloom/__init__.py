"""Vertex-centric graph analytics on Spark DataFrames."""
