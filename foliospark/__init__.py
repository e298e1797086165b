"""Document-corpus analytics on Spark: text, pages and tables as one ordered node model."""
