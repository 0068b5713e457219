"""Operators over DataFrames of the store's tables."""
