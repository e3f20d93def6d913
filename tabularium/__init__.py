"""Tabularium: document analytics as plain Spark DataFrames."""
