"""PySpark-native analytics over coded document corpora."""
