"""marklens: score evaluation and review prioritisation as Spark jobs."""

__version__ = "0.1.0"
