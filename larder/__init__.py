"""PySpark-native food-catalog analytics."""
