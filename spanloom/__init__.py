"""spanloom: a PySpark-native text scanning engine."""

__version__ = "0.1.0"
