"""Operators over tables: DataFrame to DataFrame."""
