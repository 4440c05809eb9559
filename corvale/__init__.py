"""Corvale: retrieval, ingest and catalog analytics over Spark DataFrames."""
