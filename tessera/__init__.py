"""Tessera: analytics over blocks of samples, bit streams and their decisions, on Spark DataFrames."""
