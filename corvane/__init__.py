"""corvane: a Spark-native retrieval and processing engine for code and text corpora."""

__version__ = "0.1.0"
