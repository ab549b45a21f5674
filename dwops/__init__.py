"""Warehouse analytics operators on Spark DataFrames."""
