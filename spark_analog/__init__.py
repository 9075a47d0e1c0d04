"""Retrieval-augmented anomaly detection for many multivariate time series on Spark.

Every public function maps DataFrames to DataFrames.  Series live in long
tables ``(entity, t, channel, value)``; nothing here creates a SparkSession.
"""
