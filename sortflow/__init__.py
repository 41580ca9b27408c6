"""File-corpus building, classification and move routing on PySpark."""

__version__ = "0.1.0"
