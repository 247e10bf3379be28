"""shelfmark: catalogue analytics as Spark DataFrames."""
