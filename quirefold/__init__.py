"""A document-processing engine of Spark DataFrame transforms."""
