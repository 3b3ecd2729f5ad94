"""corpusql: a PySpark-native analytics engine for page-structured document libraries."""

__version__ = "0.1.0"
