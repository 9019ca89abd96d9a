"""A strict relational query layer on Spark DataFrames."""
