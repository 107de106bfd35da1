"""Operators over the store's relations: pure functions from DataFrames and parameters to DataFrames."""
