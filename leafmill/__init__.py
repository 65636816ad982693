"""leafmill: a PySpark-native engine for archives of web pages and text corpora."""

__version__ = "0.1.0"
