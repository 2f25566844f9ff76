"""Spark-native analytics over indexed source code: scanning, extraction,
reference resolution, graph ranking, evidence retrieval and rendering, plus
data-processing operators for very large collections."""

__version__ = "0.1.0"
