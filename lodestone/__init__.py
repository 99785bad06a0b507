"""lodestone: a PySpark-native engine for research-corpus analytics."""
