"""Document-corpus preparation as Spark DataFrames: a corpus is a table, a run is a table."""
