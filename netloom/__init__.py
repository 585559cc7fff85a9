"""Spark-native analytics for planning and auditing tree-shaped utility networks."""
