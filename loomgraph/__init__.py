"""A Spark-native engine for versioned property graphs and Cypher queries."""

__version__ = "0.1.0"
