"""Keyed read models over an ordered log, on Spark DataFrames."""
