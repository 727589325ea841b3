"""inkloom: a Spark-native engine for document-translation pipelines."""

__version__ = "0.1.0"
