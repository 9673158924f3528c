"""scriptorium: a PySpark-native engine for document and text analytics."""
