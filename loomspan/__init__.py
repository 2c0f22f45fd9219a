"""A Spark-native engine for long-document question answering data."""

__version__ = "0.1.0"
