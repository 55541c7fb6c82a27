"""A PySpark-native engine for typed, provenance-tracked property graphs."""
