"""Session-log mining and retrieval as Spark jobs."""

__version__ = "0.1.0"
