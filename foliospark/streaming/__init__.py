"""Streaming jobs: additions beside the document operators."""
