"""thornmill: a PySpark-native analytics engine."""
