"""inkwright: a Spark-first engine for document-library and training-data work."""
