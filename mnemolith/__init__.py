"""A PySpark-native analytics engine for retrieval-memory research data."""
