"""Tidemark: a Spark-native engine for versioned headline records."""
