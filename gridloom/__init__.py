"""A Spark-native engine for gridded and geometric data."""
