"""Market bars, conditions, trades and statistics as PySpark DataFrame queries."""

__version__ = "0.1.0"
