"""Spark-native analytics over image-frame sequences and the time intervals derived from them."""
