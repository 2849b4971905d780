"""Search analytics on Spark: a corpus, its inverted index, a table of queries and every result are DataFrames."""

__version__ = "0.1.0"
