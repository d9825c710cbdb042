"""Multi-label data quality and evaluation as Spark DataFrame operators."""
