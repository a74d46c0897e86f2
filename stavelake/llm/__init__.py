"""Operators of a training-data pipeline, each on Spark tables; nothing else in the library imports this."""
