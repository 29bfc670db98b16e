"""Operators over store tables: DataFrames in, DataFrames out."""
