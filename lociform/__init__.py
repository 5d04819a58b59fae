"""lociform: mixed-model genomics on Spark DataFrames."""
