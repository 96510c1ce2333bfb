"""Bulk dataset-integrity and ledger analytics on Spark DataFrames."""
