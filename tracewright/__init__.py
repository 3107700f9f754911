"""Ordered-event pattern analytics and training-data operators on Spark DataFrames."""
