"""A PySpark-native analytics engine: relational, window, time-based, streaming and text operators as DataFrame code."""
