"""A PySpark-native engine for spatio-temporal lineage analytics."""
