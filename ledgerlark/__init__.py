"""A catalogue engine on Spark: typed filters, hybrid retrieval, live hydration, history, ingest and evaluation.

Operators take and return DataFrames and leave the physical plan to Catalyst.
"""
