"""engrava: Spark-native analytics over timestamped text records, vectors, typed edges and event logs."""

__version__ = "0.1.0"
