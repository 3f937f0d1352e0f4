"""driftline: change-point analytics over panels of series, as Spark plans."""

__version__ = "0.1.0"
