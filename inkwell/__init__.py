"""Pen-process analytics and training-data operators as Spark DataFrames."""
