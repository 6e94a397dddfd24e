"""Ferrule: typed data movement, verification and change streams on Spark DataFrames."""
