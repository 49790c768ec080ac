"""ebbmark: a PySpark-native engine for timestamp-indexed event logs."""

__version__ = "0.1.0"
