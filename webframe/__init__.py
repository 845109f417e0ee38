"""webframe: crawled web material as Spark DataFrames."""
