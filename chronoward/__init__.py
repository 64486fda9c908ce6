"""Chronoward: entity-keyed time-series analytics written as PySpark jobs."""

__version__ = "0.1.0"
