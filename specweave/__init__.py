"""specweave: a Spark-native engine for reconciling facts extracted from many documents."""

__version__ = "0.1.0"
