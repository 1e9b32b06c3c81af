"""turnweave: dependency edges between the turns of Q&A sessions, on Spark."""

__version__ = "0.1.0"
