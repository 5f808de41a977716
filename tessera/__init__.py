"""Incremental materialisation of derived data on Spark, and operators for training-data pipelines."""
