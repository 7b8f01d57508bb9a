"""evoria: a PySpark-native event-intelligence analytics engine."""

__version__ = "0.1.0"
