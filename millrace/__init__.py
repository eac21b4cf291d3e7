"""millrace: a Spark-native engine for governed data movement, masking and data quality."""

__version__ = "0.1.0"
