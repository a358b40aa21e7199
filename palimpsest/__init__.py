"""palimpsest: document-revision and translation-memory analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
