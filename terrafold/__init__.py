"""Spatio-temporal analytics on Spark: lazy operator graphs over DataFrames."""
