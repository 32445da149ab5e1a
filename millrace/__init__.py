"""Spark-native relational operators, table sinks and engine-fleet analytics."""
