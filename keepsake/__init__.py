"""Keepsake: a PySpark-native engine for long-term personal-memory data.

Operators are plain functions from DataFrames to DataFrames. The optional
subpackage ``keepsake.llm`` holds the text-corpus operators; nothing else in
the package depends on it.
"""

__version__ = "0.1.0"
