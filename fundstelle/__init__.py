"""fundstelle: cited retrieval, its evaluation and its operations as Spark DataFrame operators."""

__version__ = "0.1.0"
