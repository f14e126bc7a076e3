"""Spatial-cluster, evaluation and posterior-draw analytics on Spark DataFrames."""
