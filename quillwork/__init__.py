"""quillwork: a PySpark-native document analytics engine."""

__version__ = "0.1.0"
