"""strandframe: a Spark-first engine for structural-variant discovery and the relational operators behind it."""

__version__ = "0.1.0"
