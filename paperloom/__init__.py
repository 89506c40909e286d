"""Research-paper pipelines as Spark DataFrames."""
