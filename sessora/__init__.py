"""Session features, snapshots and scores from network event logs, on Spark."""

__version__ = "0.1.0"
