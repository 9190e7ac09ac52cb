"""A PySpark-native engine for media catalogs and similarity search."""
