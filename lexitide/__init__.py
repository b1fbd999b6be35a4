"""lexitide: a PySpark-native engine for studying how vocabularies change over time."""

__version__ = "0.1.0"
