"""A PySpark-native engine for pipelines over collections of research documents."""
