"""codeloom: source-code dependency graphs as Spark DataFrames."""
