"""tidelog: a PySpark-native analytics engine for time-stamped evaluation logs."""

__version__ = "0.1.0"
