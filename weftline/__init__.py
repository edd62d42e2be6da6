"""Dataflow, catalog and parity analytics on Spark DataFrames."""
