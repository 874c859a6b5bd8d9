"""Declarative lakehouse pipelines on PySpark."""

__version__ = "0.1.0"
