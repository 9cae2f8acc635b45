"""A PySpark-native engine for knowledge-memory data and for training-data corpora."""
