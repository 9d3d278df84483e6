"""Market analytics over long-format bars, as DataFrame-to-DataFrame operators on Spark."""

__version__ = "0.1.0"
