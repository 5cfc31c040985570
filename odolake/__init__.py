"""PySpark-native analytics over recorded sensor logs and pose tracks."""
