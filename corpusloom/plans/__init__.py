"""Quotas and batches as DataFrames."""
