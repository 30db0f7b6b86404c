"""cairn: a PySpark-native analytics engine for governed document and media data."""
