"""A PySpark-native engine for temporal, provenance-carrying facts with record linkage."""
