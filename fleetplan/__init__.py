"""Spark-native analytics and planning over fleets of DAG workflows."""

__version__ = "0.1.0"
