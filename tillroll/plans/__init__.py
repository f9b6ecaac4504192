"""The queries, composed from operators."""
