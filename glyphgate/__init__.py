"""Text-integrity analytics on Spark: documents in, typed and positioned findings out."""
