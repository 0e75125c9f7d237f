"""PySpark-native analytics for moving objects, spatial stores and call logs."""
