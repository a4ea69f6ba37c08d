"""sievelode: rule, graph, retrieval and signal analytics as plain Spark jobs."""

__version__ = "0.1.0"
