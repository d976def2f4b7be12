"""Declarative document-collection analytics compiled to Spark DataFrames."""

__version__ = "0.1.0"
