"""Scholiast: analytics over collections of research literature, written on Spark DataFrames."""
