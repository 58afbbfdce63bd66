"""A PySpark-native analytics engine for video-understanding data."""
