"""Document quality checks over large collections, built on Spark DataFrames."""
