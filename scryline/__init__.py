"""scryline: a PySpark-native analytics engine for code-review data."""
