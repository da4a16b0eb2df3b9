"""Spark-first engine for sparse line/channel surveys and gridded data."""

__version__ = "0.1.0"
