"""Dataset curation and paired evaluation on Spark."""
