"""Text-corpus analytics on PySpark: DataFrame operators for ingestion, retrieval, ranking and quality control."""
