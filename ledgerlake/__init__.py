"""Layered batch sales analytics on Spark DataFrames: raw, store, publish, analysis."""
