"""kindred: a recommendation engine made of Spark DataFrame jobs."""

__version__ = "0.1.0"
